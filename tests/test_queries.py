"""Registered queries against DuckDB. KARYOLOOM_FULL=1 runs all of them; the default is a sample over all modules."""

import os

import pytest

import __spark_entry__ as entry_points
import check

FOLDER = os.environ.get("KARYOLOOM_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = ["bin_pairs", "canonical_contacts", "pixels_own_resolution", "track_coverage", "gap_fraction", "expected_balanced", "insulation", "boundaries", "copy_number", "log_cpm",
          "boundary_changes", "lift_intervals", "find_genes", "gc_per_bin", "motif_best_match", "structure_size", "neighbor_pairs", "superpose_rotated", "half_stats", "roc_auc",
          "false_discovery", "match_loops", "read_vcf", "derivative_chromosomes", "bin_index", "parse_pairs", "normalize_chromosomes", "drug_likeness", "streamed_pairs"]
NAMES = list(entry_points.queries()) if os.environ.get("KARYOLOOM_FULL") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_equals_duckdb(spark, name):
    message, ok = check.compare(spark, FOLDER, name, check.duck(FOLDER))
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
