"""Operators by name: ``from tessella.operators import exemplars``; modules load when a name is first used."""

from importlib import import_module

#: Public names by module.
PUBLIC = {
    "adaptive": "adaptive_samples cleaned_mask gradient interpolate_linear mask_polygons refine_epoch",
    "autoencoder": "SparseAutoencoder embed_patches hash_embedder",
    "cluster": "FeatureClusters FrequencyRankedKMeans TokenClusters cosine_distances linkage pair_distances",
    "embedding": "EMBEDDERS coordinate_labeler embed_blocks embed_patch saliency_maps sample_slides token_maps",
    "features": "activation_stats centering cluster_extents cluster_sizes differential_abundance encode_sparse frequency_rank nearest_centroid one_hot overlaps segmentation_metrics selected_features selection_scatter soft_set strict_set",
    "filters": "closed dilated disk entropy eroded fluorescence_mask median quantile square tissue_mask",
    "geometry": "boxes extract_pixels filter_points grid_points nearest_vertices patch_boxes quadtree_cells samples_on_grid spatial_blocks transform_patches transform_points",
    "polygons": "cut_holes",
    "raster": "bilinear binary_nearest feature_maps filled_polygons integral_cells interpolated_channel nearest_seed otsu paint_max pyramid_level resized resized_cubic tile_percentiles",
    "selection": "block_order drain_order exemplars feature_gallery negative_rows pages_of patch_scores rows_with_feature saliency_rows sample_rows top_rows union_tables",
}
WHERE = {name: module for module, names in PUBLIC.items() for name in names.split()}
__all__ = sorted(WHERE)


def __getattr__(name: str):
    if name not in WHERE:
        raise AttributeError(name)
    return getattr(import_module(f".{WHERE[name]}", __name__), name)


def __dir__():
    return __all__
