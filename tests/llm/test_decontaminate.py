import hashlib

import duckdb
import pytest

from lexicrate.llm.decontaminate import OP10_SQL, decontaminate, op10_benchmark_decontamination

from .helpers import LETTERED, LOWER, frame, odd_texts, prose


def words(t):
    return LETTERED.findall((t or "").translate(LOWER))


def brute(docs, items, window=10):
    windows = {}
    for i, t in items:
        w = words(t)
        m = min(window, len(w))
        for j in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[j : j + m]), set()).add(i)
    sizes = {len(k) for k in windows}
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for m in sizes:
            for j in range(len(w) - m + 1):
                if tuple(w[j : j + m]) in windows:
                    found |= windows[tuple(w[j : j + m])]
                    hit |= set(range(j, j + m))
        out.append((repr(i), len(w), len(hit), len(found), tuple(sorted(found)), bool(hit)))
    return sorted(out)


def got(spark, docs, items):
    bench = spark.createDataFrame([(t, i, 5) for i, t in items], "text string, item_id long, n_words int")
    rows = decontaminate(frame(spark, docs), bench).collect()
    return sorted((repr(r.doc_id), r.n_words, r.n_hit, r.n_items, tuple(r.item_ids), r.contaminated) for r in rows)


@pytest.fixture(scope="module")
def items():
    long = [(i, prose(700 + i, 40)) for i in range(6)]
    return [*long, (20, None), (21, ""), (22, "lone"), (23, "three little words"), (24, "a b c d e"), (25, long[0][1])]


def test_passages_in_documents(spark, items):
    docs = odd_texts() + [(13, "w LONE w"), (14, "x three, little; WORDS three little words y"), (15, "a b c d e f")]
    for k in range(30):
        w = items[k % 6][1].split(" ")
        part = " ".join(w[k % 25 : k % 25 + 7 + k % 9])
        docs.append((100 + k, prose(k, 30) + " " + part.upper() + " " + prose(900 + k, 10 + k)))
    docs.append((200, (items[2][1] + " ") * 3))
    assert got(spark, docs, items) == brute(docs, items)


def test_query_and_sql_on_small_tables(spark, tmp_path, items):
    w = items[1][1].split(" ")
    docs = odd_texts() + [(30, prose(3, 20) + " " + " ".join(w[5:25]).upper()), (31, "three little words"), (None, w[0])]
    stems = [(40 + k, " ".join(w[:30]) + f" tail{k}") for k in range(20)]  # a stem of many items
    bench = [*items, *stems]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = sorted(
        (i, n, hit, k, hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bad)
        for i, n, hit, k, found, bad in brute(docs, bench)
    )
    out = op10_benchmark_decontamination(spark, str(tmp_path)).collect()
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((repr(r[0]), *(r[c] for c in names[1:])) for r in out) == want
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = con.execute(f"select {', '.join(names)} from ({OP10_SQL})").fetchall()
    assert sorted((repr(r[0]), *r[1:]) for r in got) == want


def test_without_short_items(spark, items):
    docs = [(i, items[i][1]) for i in range(4)] + [(9, prose(5, 50))]
    assert got(spark, docs, items[:6]) == brute(docs, items[:6])


def test_empty_tables(spark, items):
    assert got(spark, [], items) == []
    assert got(spark, odd_texts(), []) == brute(odd_texts(), [])
