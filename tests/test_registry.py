"""Registered queries against their SQL twins.

A short list runs by default; SOMAGRID_ALL=1 runs every query.
"""

import os

import pytest

import compare
from somagrid.registry import ORACLES, QUERIES, load_all

load_all()
FOLDER = os.environ.get("SOMAGRID_DATA", "/root/testdata/sf0.001")
SHORT = [
    "region_counts", "pooled_regions", "exclusions_applied", "tree_closure", "region_group_tags", "ttest_adjusted", "volcano",
    "mannwhitney", "spearman", "gene_screen", "nearest_cells", "density_clusters", "invert_field", "label_boundaries",
    "distance_to_background", "otsu_threshold", "triangle_threshold", "resize_labels", "components_26", "largest_component",
    "overlaps_split", "box_clusters", "detection_scores", "predicted_positions", "moving_average", "tree_paths", "bridged_ends",
    "tile_grid", "read_ontology", "read_trees", "ingested_blocks", "streamed_region_counts", "streamed_tracks",
]
NAMES = sorted(QUERIES) if os.environ.get("SOMAGRID_ALL") else SHORT


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name not in ORACLES:
        assert df.count() > 0
        return
    bad = compare.compare(df, con, ORACLES[name])
    assert not [b for b in bad if not b.startswith("note")], bad


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "region_density_by_group" in e.queries()
    assert e.entry(spark).columns == ["ids", "acronym", "exp", "density_w", "density_large_w", "n_brains"]
