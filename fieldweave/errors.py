"""Errors of the library; each stage has its own."""


class SceneError(Exception):
    """Base of all errors raised here."""


class ConfigurationError(SceneError):
    pass


class ProviderError(SceneError):
    pass


class CandidateError(SceneError):
    pass


class DownloadError(SceneError):
    pass


class ProcessingError(SceneError):
    pass


class AlignmentError(SceneError):
    pass


class FeatureError(SceneError):
    pass


class SequenceError(SceneError):
    pass


class GraphError(SceneError):
    pass


class DatasetError(SceneError):
    pass


class ModelInputError(SceneError):
    pass
