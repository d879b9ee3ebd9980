import __spark_entry__ as entry
from asofkit.catalog import registry


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    unchecked = set(registry.QUERIES) - set(registry.ORACLES)
    # approximate indexes and learned models have no SQL counterpart
    assert unchecked == {
        "t21_cell_index", "t23_index_quality", "t18_learned_vectors", "t18_model_selection",
        "t28_ranker", "t30_feature_pruning", "t34_methods",
    }


def test_entry_runs(spark):
    found = entry.entry(spark)
    assert found.count() > 0 and "user_events_1h" in found.columns
