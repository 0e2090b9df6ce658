"""Turn repair, license scans and ranked search beside SQL, brute force and small known cases."""

import itertools
import random

import duckdb
import pytest
from helpers import EDGES, LONG, clashing, documents
from pyspark.sql import functions as F

from shopledger.llm import license_scan, ranked_search, turn_repair

CONV = "conv_id bigint, turn bigint, role string, text string"
ITEMS = "item_id bigint, text string"


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def beside_sql(spark, folder, tables, query, sql):
    """Rows of a query over the tables, once equal to those of its SQL."""
    con = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    got = query(spark, str(folder))
    rows = [tuple(r) for r in got.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert canonical(got.columns, rows) == canonical(names, cursor.fetchall())
    return [r.asDict() for r in got.collect()]


# Conversations


def valid(roles):
    body = roles[1:] if roles[:1] == "s" else roles
    return roles == "" or (body != "" and body == "ua" * (len(body) // 2))


def brute(symbols):
    """(cost, audit) over all edits, with at most two insertions before every row and at the end."""
    best = None

    def grow(i, roles, cost, audit):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(symbols):
            for more in ("", "u", "a", "ua", "au"):
                if valid(roles + more):
                    found = (cost + 3 * len(more), audit + "I" * len(more))
                    best = found if best is None else min(best, found)
            return
        s = symbols[i]
        for more in ("", "u", "a", "ua", "au"):
            r, c, a = roles + more, cost + 3 * len(more), audit + "I" * len(more)
            grow(i + 1, r, c + 4, a + "D")
            if s != "x":
                cut = 3 if s.isupper() else 0
                grow(i + 1, r + s.lower(), c + cut, a + "K")
                for role in "ua":
                    grow(i + 1, r + role, c + 3 + cut, a + "R")

    grow(0, "", 0, "")
    return best


def test_cheapest_edits_equal_all_edits():
    for n in range(4):
        for symbols in itertools.product("xsuaoSUAO", repeat=n):
            assert turn_repair.cheapest("".join(symbols)) == brute("".join(symbols)), symbols
    rng = random.Random(4)
    for _ in range(60):
        symbols = "".join(rng.choice("xsuaUA") for _ in range(5))
        assert turn_repair.cheapest(symbols) == brute(symbols), symbols


@pytest.mark.parametrize("symbol", "xsuoA")
def test_a_run_by_powers_equals_row_by_row(symbol):
    after = (0, 6, 3, 0)
    step = after
    for n in range(1, 40):
        step = turn_repair.advanced(symbol, 1, step)
        assert turn_repair.advanced(symbol, n, after) == step
    cost, audit = turn_repair.cheapest(symbol * 5000)
    assert sum({"K": 0, "D": 4, "I": 3, "R": 3}[x] for x in audit) + 3 * symbol.isupper() * sum(x in "KR" for x in audit) == cost
    assert sum(x != "I" for x in audit) == 5000


def turns(n=60):
    rng = random.Random(n)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "  ", "cut off", "Why? \n", "Ja. ", "été.", None, f"t{turn}."])
            rows.append((conv, rng.choice([turn, turn, 2 * turn, None]), role, text))
    rows += [(1000 + i, i, "user", "hi.") for i in range(n)]  # some lose their only row
    return rows + rows[:5] + [(None, None, None, None), (None, 1, "user", "a."), (None, 2, "assistant", "b."), (777, 1, "user", LONG)]


def test_turn_repair_equals_sql(spark, tmp_path):
    table = spark.createDataFrame(turns(), CONV)
    rows = beside_sql(spark, tmp_path, {"conversations": clashing(table)}, turn_repair.op11, turn_repair.ORACLE)
    assert {r["conv_id"] for r in rows} == {c for c, *_ in turns()}
    for counted in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"):
        assert any(r[counted] for r in rows)
    assert any(r["audit"] == "" for r in rows)


def test_turn_repair_edges(spark):
    none = spark.createDataFrame([], CONV)
    assert turn_repair.repair(none).collect() == [] and turn_repair.damaged(none).collect() == []
    rows = [(1, 0, "user", "hi."), (1, 1, "user", "hi."), (2, 0, "system", "only."), (3, 0, "user", "a."), (3, 5, "assistant", "b.")]
    found = {r["conv_id"]: r for r in turn_repair.repair(clashing(spark.createDataFrame(rows, CONV))).collect()}
    assert (found[1].duplicate, found[1].audit, found[1].cost) == (1, "KDI", 7)
    assert [tuple(t) for t in found[1].repaired] == [("user", "hi."), ("assistant", "")]
    assert (found[2].audit, found[2].repaired) == ("D", []) and (found[3].gaps, found[3].audit, found[3].cost) == (4, "KK", 0)
    away = spark.createDataFrame([(1, 0, "user", "x.", False)], CONV + ", live boolean")
    assert tuple(turn_repair.repair(away, live="live").first()) == (1, 0, 0, 0, 0, 0, 0, "", [])
    dear = turn_repair.Costs(delete=50, insert=1)
    row = turn_repair.repair(spark.createDataFrame([(1, 0, "system", "only.")], CONV), dear).first()
    assert (row.audit, row.cost) == ("KII", 2)
    named = spark.createDataFrame([("c", 0, "user", "a.")], CONV.replace("conv_id bigint", "conv_id string"))
    assert turn_repair.repair(named).first()["conv_id"] == "c"


# Licenses


MIT = next(t.text for t in license_scan.NOTICES if t.label == "mit")


def license_texts():
    changed = MIT.split()
    changed[20:22] = ["the", "program"]
    del changed[40]
    texts = [
        "GNU General Public License", "gnu-general, PUBLIC\nlicense x mit license", "gnu general public", "CC BY CC BY by cc by",
        MIT, " ".join(changed).upper(), f"{MIT} and again {MIT}", MIT[: len(MIT) // 3], "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-ND 4.0.", "Licensed under the Apache License, Version 2.0.", "cc\u00a0by", "émit license mit licenseé",
        "This work is licensed under the GNU General Public License, version 3.", "mit", " MIT  License " * 3000, "1mit license", "KK cc by",
    ]
    return [(100 + i, t, "en", "s", 0) for i, t in enumerate(texts)] + [*EDGES, (100, texts[0], "en", "s", 0)]


def test_license_scan_equals_sql(spark, tmp_path):
    docs = documents(spark, license_texts()).repartition(3)
    rows = beside_sql(spark, tmp_path, {"documents": clashing(docs)}, license_scan.op12, license_scan.ORACLE)
    found = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(license_texts())
    base = lambda i: (found[i]["n_base"], found[i]["first_word"], found[i]["last_word"], found[i]["base_labels"])
    assert base(100) == (1, 0, 0, "gpl") and base(101) == (2, 0, 5, "gpl,mit") and base(102) == (0, None, None, "")
    assert base(103) == (3, 0, 5, "cc-by") and base(115) == (3000, 0, 5998, "mit") and base(116)[0] == 0
    assert base(111) == base(112) == (0, None, None, "")
    assert found[104]["labels"] == "mit" == found[105]["labels"] and found[104]["score"] == 1.0 > found[105]["score"] > 0.75
    assert found[107]["labels"] == "" == found[109]["labels"].replace("cc-by", "")
    assert found[108]["labels"] == "cc-by,cc-by-nc" and found[110]["labels"] == "apache,apache-2.0" and found[113]["labels"] == "gpl,gpl-3.0"
    assert (found[1]["n_words"], found[1]["labels"], found[1]["score"]) == (0, "", 0.0)


def test_diagonals_are_merged_and_verified(spark):
    changed = MIT.split()
    changed.insert(25, "indeed")
    text = f"before it {' '.join(changed)} after"
    spans = license_scan.scan(clashing(documents(spark, [(1, text, "", "", 0)])), ["doc_id", "kept"]).first()["spans"]
    assert [(s.label, s.start, s.end) for s in spans] == [("mit", 2, 2 + len(changed))]
    apart = [license_scan.Template("mit", MIT, slack=0)]
    alone = license_scan.scan(documents(spark, [(1, text, "", "", 0)]), ["doc_id"], apart).first()["spans"]
    assert alone == []  # neither diagonal has three quarters of the words
    assert license_scan.scan(documents(spark, [])).collect() == []


# Search


def test_ranked_search_equals_sql(spark, tmp_path):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "été", "it's", "A", "a", " x"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 40))) for _ in range(120)]
    docs = [(i * 7 % 120, t, "", "", 0) for i, t in enumerate(texts)] + [(9, texts[0], "", "", 0), (9, texts[0], "", "", 0), *EDGES[:-2], EDGES[-1]]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 12)))) for i in range(30)]
    items += [(40, None), (41, ""), (42, "nowhere"), (43, "w1 W1 w1"), (None, "w2 w3"), (3, items[3][1]), (3, "w5")]
    tables = {"documents": clashing(documents(spark, docs)).repartition(5), "benchmark": clashing(spark.createDataFrame(items, ITEMS))}
    rows = beside_sql(spark, tmp_path, tables, ranked_search.op13, ranked_search.ORACLE)
    assert all(r["score"] > 0 and 1 <= r["rank"] <= 20 for r in rows) and not any(r["item_id"] in (40, 41, 42) for r in rows)


def test_blocks_and_small_heaps_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    docs = documents(spark, [(i, " ".join(rng.choices("abcdefghij", k=9)), "", "", 0) for i in range(200)] + [(None, "a b", "", "", 0)]).repartition(4)
    items = spark.createDataFrame([(i, " ".join(rng.choices("abcdefghijk", k=3))) for i in range(25)], ITEMS)
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = key(ranked_search.search(docs, items, top=4))
    assert key(ranked_search.search(docs.repartition(9), items, top=4, block_items=6)) == want
    assert len(want) == 100 and {r[1] for r in want} == {1, 2, 3, 4}
    index = ranked_search.ItemIndex.of([(1, "a b b"), (2, "b c")])
    index.weight, index.documents, index.length = ranked_search.np.array([5, 7, 11]), 2, 6
    whole = ranked_search.scores(index, [b"a b c", b"c c", None, b"zz"])
    monkeypatch.setattr(ranked_search, "TRIPLES", 1)
    assert (ranked_search.scores(index, [b"a b c", b"c c", None, b"zz"]) == whole).all() and whole[2:].sum() == 0 and whole[0, 0] > 0
    assert ranked_search.search(docs.limit(0), items).collect() == [] == ranked_search.search(docs, items.limit(0)).collect()
    named = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    assert len(ranked_search.search(docs, named, top=4).collect()) == 100
