"""Column functions: raster arithmetic, spectral indices, similarity."""

from .arithmetic import as_float, clip, cosine_similarity, decibels, greater, guarded, minmax, normalized_difference, ones_like, safe_ratio, scale, standardize, zeros_like
from .indices import entropy, evi, gci, homogeneity, ndvi, ndwi, savi

__all__ = [
    "as_float", "clip", "cosine_similarity", "decibels", "greater", "guarded", "minmax", "normalized_difference", "ones_like", "safe_ratio", "scale", "standardize", "zeros_like",
    "entropy", "evi", "gci", "homogeneity", "ndvi", "ndwi", "savi",
]
