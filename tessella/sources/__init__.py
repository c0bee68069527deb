"""Sources and sinks by name; modules load when a name is first used."""

from importlib import import_module

PUBLIC = {
    "slides": "Registration auto_pyramid multiscale read_pyramid tiled to_cyx untiled write_channel write_pyramid write_roi_mask write_training_set",
    "tiff": "Tiff encoded_tiff tiff_pages tiff_tiles write_tiffs",
    "tables": "Container export_patches levels merged_metadata overlaid overwrite_element read_rois_csv read_rois_xml read_samples tile_grid write_samples",
}
WHERE = {name: module for module, names in PUBLIC.items() for name in names.split()}
__all__ = sorted(WHERE)


def __getattr__(name: str):
    if name not in WHERE:
        raise AttributeError(name)
    return getattr(import_module(f".{WHERE[name]}", __name__), name)


def __dir__():
    return __all__
