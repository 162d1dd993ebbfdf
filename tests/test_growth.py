"""What a query does must not grow faster than its input."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from equiloom.functions import dates
from equiloom.operators import phrases, themes
from equiloom.plans import registry
from equiloom.sources import json_walk, markup

SF = "/root/testdata/sf0.001"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_walk_reads_its_input_once(spark):
    """However deep the documents, and whatever they are made of."""
    assert optimized(registry.queries()["s12_shareholders"](spark, SF)).count("Relation [l_orderkey") == 1


def test_walk_tells_the_deepest(spark):
    deep = lambda n: spark.createDataFrame([("[" * n + '{"name":"a"}' + "]" * n,)], "v string")
    found = lambda n: [(r.depth, r["name"]) for r in json_walk.named_objects(deep(n), "v", wanted=lambda x: x == "a").collect()]
    assert found(json_walk.DEEPEST - 1) == [(json_walk.DEEPEST - 1, "a")]
    with pytest.raises(Exception, match="nest deeper"):
        found(json_walk.DEEPEST)


def mined(rows, known, longest, least, top):
    held: dict = {}
    for key, said in rows:
        w = said.split()
        held.setdefault(key, set()).update(" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    hits = Counter(p for ps in held.values() for p in ps)
    return sorted(((p, n) for p, n in hits.items() if n >= least and p not in known), key=lambda x: (-x[1], x[0]))[:top]


@pytest.mark.parametrize("prune", [1000, 3])
def test_mined_phrases(spark, monkeypatch, prune):
    """Frequent runs by brute force: keys of several rows, ties, a null key, and
    more frequent words than are told apart."""
    import random

    monkeypatch.setattr(themes, "PRUNE", prune, raising=False)
    draw = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "sigma", "omega", "kappa", "theta", "iota", "zeta"]
    rows = [(draw.choice([None, *range(25)]), " ".join(draw.choices(words, range(10, 0, -1), k=draw.randint(0, 9)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "k int, t string")
    for known, longest, least, top in ((["alpha"], 3, 3, 8), ([], 1, 2, 4), (words, 3, 2, 30), (["beta"], 2, 26, 5), (["beta"], 2, 99, 5)):
        got = [tuple(r) for r in themes.mine(df, "t", "k", known, longest, least, top).collect()]
        assert got == mined(rows, known, longest, least, top)


def test_mining_counts_where_rows_are(spark):
    """No pair of row and phrase goes through a shuffle."""
    plan = optimized(registry.queries()["a34_mining"](spark, SF))
    assert not [line for line in plan.splitlines() if "Aggregate [doc_id#" in line and "phrase#" in line]


def test_pieces_are_made_once(spark):
    """A text's pieces come from one search per expression, however many columns read them."""
    assert optimized(registry.queries()["t21_segments"](spark, SF)).count("regexp_extract_all") == 2


def test_forms_of_dates(spark):
    """Each form as when all are tried, and only those tried that can fit."""
    said = ["05-Mar-2024", "5-mar-2024", "5-3-2024", "0005-1-2024", "5/3/2024", "99/99/2024", "2024-03-05", "2024-3-5", "2024-03-05 ", "31-Feb-2024", "-5-3-2024", "5-3-12024", "2024/03/05", "", "-", "x", None]
    plain = F.coalesce(*[F.try_to_date("x", f) for f in ("d-MMM-yyyy", "d-M-yyyy", "d/M/yyyy", "yyyy-MM-dd")])
    df = spark.createDataFrame([(x,) for x in said], "x string").select("x", plain.alias("a"), dates.parse_trade_date(F.col("x")).alias("b"))
    assert [r.b for r in df.collect()] == [r.a for r in df.collect()]
    assert sum(r.b is not None for r in df.collect()) >= 4
    assert str(dates.parse_trade_date(F.col("x"))).count("CASE WHEN") >= 4


def test_feeds_are_ranked_before_companies(spark):
    """A feed's turns are cut to thirty before they are sorted and joined."""
    assert "WindowGroupLimit" in optimized(registry.queries()["a37_catalysts"](spark, SF))


def reader(monkeypatch, df, make):
    """The function that `make` gives to Arrow."""
    held = []
    with monkeypatch.context() as m:
        m.setattr(type(df), "mapInArrow", lambda self, f, schema: held.append(f))
        make(df)
    return held[0]


def test_records_do_not_copy_their_page(spark, monkeypatch):
    df = spark.createDataFrame([], "k int, v string")
    run = reader(monkeypatch, df, lambda x: markup.html_rows(x, "v", "k"))
    page = "<table>" + "<tr><td>x</td></tr>" * 9000 + "</table>" + " " * 300_000
    taken = []
    plain = pa.RecordBatch.take
    batch = pa.RecordBatch.from_arrays([pa.array([7], pa.int32()), pa.array([page])], ["k", "_text"])

    class Watched:
        """A batch whose copies are noted."""

        def __init__(self, of):
            self.of = of

        def __getattr__(self, name):
            return getattr(self.of, name)

        def select(self, which):
            return Watched(self.of.select(list(which)))

        def take(self, at):
            taken.append(plain(self.of, at).nbytes if self.of.num_columns == 1 else len(page) * len(at))
            return plain(self.of.select([0]), at)

    out = list(run(iter([Watched(batch)])))
    assert sum(b.num_rows for b in out) == 9000 and max(b.num_rows for b in out) <= 4096
    assert set(out[0].column(0).to_pylist()) == {7}
    assert sum(taken) < len(page)


def test_texts_are_read_one_at_a_time(spark, monkeypatch):
    """No batch of texts stands beside itself as Python strings."""
    df = spark.createDataFrame([], "k int, v string")
    run = reader(monkeypatch, df, lambda x: phrases.scan(x, "v", phrases.Phrases(["solar"]), "k"))

    class Column(list):
        def to_pylist(self):
            raise AssertionError("the whole batch")

    class Batch:
        columns, num_rows = [pa.array([1, 2], pa.int32())], 2
        schema = pa.schema([("k", pa.int32()), ("__v", pa.string())])
        column = staticmethod(lambda i: Column(pa.array(["a solar park", None])))

    assert [b.column(1).to_pylist() for b in run(iter([Batch]))] == [[[0], []]]
