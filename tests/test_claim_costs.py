"""Claims at size: what is not done twice, and that the shorter ways give the same."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from capturelake.functions import rx
from capturelake.functions import text as T
from capturelake.operators import claims as C
from capturelake.operators import merge

AS_OF = datetime(2024, 6, 1)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def bundles(spark, names, entities):
    """One document with a claim for each pair of names."""
    claim = C.made_claim("me", F.lit("did"), F.lit("x"), "actor", F.lit("fact"), F.lit(0.5), F.lit("2024-02-02T00:00:00Z"), F.lit("x"))
    rows = spark.createDataFrame(
        [("d", "d", "x-d", names, entities)],
        "document_id string, entry_id string, extraction_id string, names array<struct<s:string,o:string>>, told array<struct<name:string,entity_type:string>>",
    )
    made = F.transform("names", lambda n: claim.withField("subject_entity_name", n["s"]).withField("object_entity_name", n["o"]))
    told = F.transform("told", lambda e: C.record(C.ENTITY, name=e["name"], entity_type=e["entity_type"], aliases=F.array().cast("array<string>")))
    return rows.withColumn("claims", made).withColumn("entities", told).withColumn("links", F.array().cast(f"array<{C.LINK}>"))


def test_types_of_few_and_many_entities_agree(spark):
    rng = random.Random(5)
    for n in (0, 3, C.FEW_NAMES, C.FEW_NAMES + 1, 200):
        known = [*(f"n{k}" for k in range(n // 2 + 1)), None]
        entities = [(rng.choice(known), rng.choice(["place", "person", "concept"])) for _ in range(n)]
        names = [(rng.choice([*known, "gone"]), rng.choice([*known, "gone"])) for _ in range(50)]
        last = {name: kind for name, kind in entities if name is not None}
        b = bundles(spark, names, entities).select("claims", "entities")
        for side, k in (("subject_entity_name", 0), ("object_entity_name", 1)):
            got = b.select(C._named_types(F.col(f"claims.{side}"), F.col("entities"))).first()[0]
            assert got == [last.get(pair[k]) for pair in names]


def test_lists_of_claims_are_made_without_entity_types(spark):
    b = bundles(spark, [("n", "m")], [("n", "place")])
    tables = C.write_bundle(spark.createDataFrame(b.collect(), b.schema), AS_OF)
    for name in ("spans", "dimensions"):
        assert "entities" not in plan(tables[name]).split("LogicalRDD")[0]
    # an array that grows in a fold is copied at every step
    assert "aggregate(" not in plan(tables["claims"])


def test_topics_are_carried_without_a_fold(spark):
    rng = random.Random(7)
    for n in (0, 1, 2, 40):
        values = [rng.choice([None, None, "a", "b", "c"]) for _ in range(n)]
        df = spark.createDataFrame([(values,)], "v array<string>")
        want, last = [], None
        for v in values:
            want.append(last)
            last = last if v is None else v
        carried = df.select(C._carried(F.col("v")))
        assert carried.first()[0] == want and "aggregate(" not in plan(carried)


def test_values_are_stripped_as_texts(spark):
    texts = ["", "x", "日本", "é", "a\u0085b", "。", *T.WHITESPACE]
    texts += [a + m + b for a in ("", *T.WHITESPACE) for m in ("x", "x y", "日本", "é") for b in ("", *T.WHITESPACE)] + [None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.where(~T.strip("t").eqNullSafe(T.strip_value("t"))).count() == 0


def test_first_of_few_and_many_members(spark):
    rng = random.Random(9)
    for n in (0, 1, rx.FEW, rx.FEW + 1, 100):
        items = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), k) for k in range(n)]
        df = spark.createDataFrame([(items,)], "v array<struct<s:string,n:int,k:int>>")
        got = df.select(rx.first_by(F.col("v"), lambda x: [x["s"], x["n"]]).alias("v")).first().v
        first = {}
        for s, m, k in items:
            first.setdefault((s, m), k)
        assert [x.k for x in got] == list(first.values())


def test_positions_need_no_join_and_go_on_over_parts(spark, tmp_path):
    # one key over all parts, keys over two, null keys, and columns named as those of the operator's own frames
    rows = spark.range(3000).selectExpr("if(id < 2000, 'hot', if(id < 2010, null, concat('k', id % 7))) AS k", "id AS _key", "id % 5 AS _n")
    for parts in (1, 3, 16):
        out = merge.ranked_children(rows, "k", [F.asc("_key")], f"{tmp_path}/{parts}", parts=parts)
        want, seen = {}, {}
        for r in sorted(rows.collect(), key=lambda r: r._key):
            want[r._key] = seen.get(r.k, 0)
            seen[r.k] = want[r._key] + 1
        assert {r._key: r.position for r in out.collect()} == want and out.columns == ["k", "_key", "_n", "position"]
        assert "Join" not in plan(out) and "Window" not in plan(out)
    assert merge.ranked_children(rows.where("false"), "k", [F.asc("_key")], f"{tmp_path}/none").count() == 0
