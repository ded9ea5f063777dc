"""Tables of the library.

``scenes`` has a row per scene, ``pixels`` a row per pixel with a nullable
column per band. ``input_ord`` keeps the order in which scenes were given, as
ties between them are broken by it.
"""

SCENES = "scene_id string, modality string, acquisition_date string, crs string, resolution_m double, height int, width int, input_ord long, metadata map<string,string>"
PIXEL_KEY = ["scene_id", "row", "col"]
NODES = "node_id long, x double, y double, features array<double>, irrigation_id string, soil_type string, rainfall_mm double"
EDGES = "src long, dst long, distance_m double, shared_irrigation double, soil_similarity double, rainfall_similarity double"
ISSUES = "severity string, rule string, subject string, message string"
OBSERVATIONS = "observation_id string, acquisition_date string, optical_scene_id string, sar_scene_id string, crs string, resolution_m double, pairing string, delta_days int"

#: Names under which a band may be found, first match first. Fixed values.
ALIASES = {
    "red": ("red", "B04"),
    "nir": ("nir", "B08"),
    "blue": ("blue", "B02"),
    "green": ("green", "B03"),
    "swir": ("swir", "B11"),
    "vv": ("VV", "vv"),
    "vh": ("VH", "vh"),
}
