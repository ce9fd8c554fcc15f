"""Every query of the library against its SQL on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from docnav.plans import catalog

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not there")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(rows, names):
    def one(v):
        return f"{float(v):.5g}" if isinstance(v, float | Decimal) and not math.isnan(v) else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_evidence_of_letters_that_upper_case_makes_longer(spark, tmp_path):
    texts = {1: "Enpfäach in ßßß ungente lichung", 2: "Enßst heittzß enzu geß.\nTzä enteenü", 3: "ŉ İstanbul ıǰ ﬃ and more of it", 4: "plain words that stand here"}
    rows = [(i, turn, "user", text) for i, t in texts.items() for turn, text in enumerate((t, "another turn"))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(SQL["evidence_checks"])
    names = [d[0] for d in want.description]
    got = QUERIES["evidence_checks"](spark, str(tmp_path))
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), names)


def test_scores_on_a_tie_are_written_as_sql_does(spark, tmp_path):
    """Page 2 scores 0.6625, a double just below it: printf writes 0.662, Java's formatter 0.663."""
    texts = (
        "Be anhebleer ndor and erhaes a a, enntble is ated heer in. Heing thenly thndingtion onrean a, oneatiin relyesan thensh.",
        "Anhain the edou edrewh. Or inhaen hahe esenou the. Thtiones thoranor inedre erntan anble hewhsh thenndth onth from thre ndhand onndble ndwhly ersh, shrehe toonattiin threon thedblehe andheinshnt thble tied, ingsh heedon "
        "rere was ouen tionblewh it, onor anndre ofheonatin ndin ouat to the thnded ertithat anouou, of onouheou whin erwhed ndthed erble it thth ingthhe the oninnt in eaha be thin. Shth, thhere a a, orti.\nAtth.\nNdsble, erstin was the.",
        "Intion enonat onon thst, eran, onhe anre the ernthaon thouat, ed. Ththther ertion thshrent thstble thatenst erndea ertion that orhant to from the.",
    )
    spark.createDataFrame([(403891, i, r, t) for i, (r, t) in enumerate(zip(("system", "user", "assistant"), texts, strict=True))], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(SQL["region_fusion"])
    names = [d[0] for d in want.description]
    got = QUERIES["region_fusion"](spark, str(tmp_path))
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), names)


def test_decision_table_is_made_from_the_orders(spark):
    """Every combination comes, and all orders are counted."""
    got = QUERIES["decision_table"](spark, DATA).collect()
    assert len({(r["status"], r["verdict"], r["quote_ok"], r["round"]) for r in got}) == 72
    assert sum(r["runs"] for r in got) == spark.read.parquet(f"{DATA}/orders.parquet").count()
