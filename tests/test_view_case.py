"""Upper case in the views, as the checking engine has it."""

import duckdb

from reportloom.plans.views import Views, checking_sql

ODD = ["xxxxxxxxieüauß dr rest", "xxxxxxxxﬁ ŉ ǰ ᾳ ß", "xxxxxxxxåäö éñ 漢 😀ß", "xxxxxxxx", "short", None]


def test_upper_maps_one_character_to_one(spark):
    rows = [(20 + 80 * i, text) for i, text in enumerate(ODD)]
    made = {
        "documents": spark.createDataFrame([(i, t) for i, t in rows], "doc_id bigint, text string"),
        "embeddings": spark.createDataFrame([(i, [1.0]) for i, _ in rows], "vec_id bigint, embedding array<float>"),
        "nation": spark.createDataFrame([(i, f"N{i}") for i in range(25)], "n_nationkey int, n_name string"),
        "region": spark.createDataFrame([], "r_regionkey int, r_name string"),
    }
    views = Views(spark, "nowhere")
    views._made.update(made)
    got = {r["query_id"]: r["term"] for r in views["searches"].collect()}
    connection = duckdb.connect()
    for name, df in made.items():
        connection.register(name, df.toArrow())
    want = dict(connection.execute(checking_sql("SELECT query_id, term FROM {searches}")).fetchall())
    assert got == want and got[20] == "IEÜAUẞ D"
