import os

import pytest

import __spark_entry__
from tests.conftest import SMALL

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _run_here():
    """The core queries without an oracle, and one with one of each kind; the others are compared with their SQL by the driver."""
    with_oracle = __spark_entry__.oracle_sql()
    return sorted({k for k, f in __spark_entry__.queries().items() if ".llm." not in f.__module__ and k not in with_oracle} | {"p3_found", "q_health_score", "q_hybrid_files", "q_classify_claims", "q_pre_meeting_brief", "q_csv_commit_chunks", "s_daily_digest"})


@pytest.mark.parametrize("name", _run_here())
def test_queries_run(spark, name):
    df = __spark_entry__.queries()[name](spark, SMALL)
    assert len(df.limit(1).collect()) >= 0 and len(set(df.columns)) == len(df.columns)
