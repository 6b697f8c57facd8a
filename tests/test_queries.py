"""A sample of the named queries against their SQL; the rest run in the driver's own comparison."""

import pytest

from tests.oracle import check

NAMES = ["tile_keys", "tile_even_sample", "pair_check", "slice_percentile_mask", "otsu_mask", "reindex_dense", "seed_peaks_kernel", "object_screen", "accept_policy", "overlap_pairs", "detection_metrics", "split_merge", "face_edges", "halo_assemble", "qc_status", "nearest_exemplar", "dispatch_loo", "mosaic_ids"]


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    import __spark_entry__ as entry

    check(spark, name, entry.queries(), entry.oracle_sql())
