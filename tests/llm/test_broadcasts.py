"""No step of the near-duplicate search sends a table to the driver to broadcast it, however small Spark takes it to be."""

from urbangrid.llm import minhash
from urbangrid.operators import components


def test_near_duplicates_join_by_shuffle(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join([*words[:59], "x"]), " ".join([*words[:30], "y", *words[30:59], "z"]), " ".join(reversed(words)), ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    plans = {}

    def seen(real):
        def step(df, name):
            plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
            return real(df, name)

        return step

    monkeypatch.setattr(minhash, "written", seen(minhash.written))
    monkeypatch.setattr(components, "stored", seen(components.stored))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
        found = minhash.near_duplicates(docs, shingle=3, percent=85)
        plans["result"] = found._jdf.queryExecution().executedPlan().toString()
        rows = {r.doc_id: r.component_id for r in found.collect()}
        one = minhash.keep_one(docs, shingle=3, percent=85)
        plans["kept"] = one._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert rows[0] == rows[1] == 0 and rows[3] == 3 and rows[4] == 4
    assert {"posts", "wanted", "sets", "tested", "components"} <= set(plans)
    assert [name for name, plan in plans.items() if "Broadcast" in plan] == []
