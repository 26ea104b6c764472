"""What Spark makes of the operators: pushdown, pruning, partial work, no Python rows."""

import re

import pytest

from songsift.operators.clusters import first_members
from songsift.operators.counts import count_by, top_k
from songsift.operators.quality import drop_missing, drop_zero, missing_profile
from songsift.operators.similarity import artist_features
from songsift.plans.popularity import songs_per_year, sound_of_popular_terms
from songsift.registry import load
from songsift.registry.data import artists, catalogue
from songsift.sources.catalogue import read_catalogue, write_catalogue
from tests.conftest import plan_of

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups", "PythonUDF")
LAZY = """count_by_year artists_per_location token_count sound_by_token missing_profile
drop_missing list_parse float_parse artist_features overlap_score cluster_members
enrich_tags ragged_arrays decode_text""".split()


@pytest.fixture(scope="module")
def stored(spark, songs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "songs")
    write_catalogue(songs, path)
    return read_catalogue(spark, path)


def schema_read(plan):
    return re.findall(r"ReadSchema: struct<([^>]*)>", plan)


def test_count_reads_one_column_and_pushes_the_filter(stored):
    plan = plan_of(songs_per_year(stored))
    assert schema_read(plan) == ["year:int"]
    assert "IsNotNull(year)" in plan and "Not(EqualTo(year,0))" in plan
    assert "partial_count" in plan


def test_customers_are_joined_to_the_orders(spark, sf_dir):
    """Which are fewer than the songs, so that the songs go through one shuffle less."""
    plan = plan_of(catalogue(spark, sf_dir, "song_id", "artist_name", "artist_location", "title"))
    assert plan.index("p_partkey") < plan.index("o_orderkey")
    depth = {key: len(line) - len(line.lstrip(" :+-")) for line in plan.splitlines() if "FileScan" in line
             for key in ("l_orderkey", "c_custkey", "n_nationkey", "p_partkey") if f"[{key}" in line}
    assert depth["c_custkey"] > depth["l_orderkey"] > 0 and depth["n_nationkey"] > depth["l_orderkey"]


def test_missing_filter_is_pushed(stored):
    plan = plan_of(drop_zero(drop_missing(stored.select("tempo", "title")), "tempo"))
    assert "IsNotNull(tempo)" in plan and "IsNotNull(title)" in plan
    assert schema_read(plan) == ["title:string,tempo:double"]


def test_missing_profile_is_one_scan(stored):
    assert plan_of(missing_profile(stored, ["tempo", "loudness", "title"])).count("FileScan") == 1


def test_top_k_keeps_k_rows_per_task(stored):
    assert "TakeOrderedAndProject" in plan_of(top_k(count_by(stored, "year"), 3, "count", "year"))


def test_artist_features_scans_once_and_hashes_first(stored):
    plan = plan_of(artist_features(stored))
    assert plan.count("FileScan") == 1
    deepest = [line for line in plan.splitlines() if "Aggregate" in line][-1]
    assert "HashAggregate" in deepest and "partial_sum" in deepest


def test_top_terms_are_broadcast(stored):
    plan = plan_of(sound_of_popular_terms(stored))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_first_members_limits_before_the_shuffle(spark, sf_dir):
    plan = plan_of(first_members(artists(spark, sf_dir), 3, "artist_id"))
    limits = re.findall(r"WindowGroupLimit.*(Partial|Final)", plan)
    assert sorted(limits) == ["Final", "Partial"]


@pytest.mark.parametrize("name", LAZY)
def test_no_python_rows_and_no_cross_join(spark, sf_dir, name):
    plan = plan_of(load()[name].run(spark, sf_dir))
    assert not any(node in plan for node in PYTHON_NODES)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


