"""The pipeline's stages against plain versions, each on its own input."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from shelfmatch.llm import decontamination, language_id, queries, sentencepiece_codec
from shelfmatch.llm._common import store
from tests.llm.test_operators import WORDS, _plain_bits, _plain_fingerprint, _plain_lines, _plain_passages

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    out = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert out.columns == names
    first = {r.doc_id: r.text for r in out.collect()}
    assert set(first) >= {r.doc_id for r in docs.collect() if len(r.text) > 200}
    out = store(corpus_pipeline.STAGES[1][1](spark, store(out, "one"), SF), "two")
    assert out.columns == names
    second = {r.doc_id: r.text for r in out.collect()}
    drops = _plain_lines(first.items())
    want = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in drops) for i, t in first.items()}
    assert second == {i: t for i, t in want.items() if t.strip() or not any(d == i for d, _ in drops)}
    out = store(corpus_pipeline.STAGES[2][1](spark, out, SF), "three")
    third = {r.doc_id: r.text for r in out.collect()}
    f = {i: _plain_fingerprint(t) for i, t in second.items()}
    near = {i: [j for j in f if (f[i] ^ f[j]).bit_count() <= 4] for i in f}
    least = {}
    for i in sorted(f):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in least:
                least[k] = i
                todo += near[k]
    assert set(third) == set(least.values())
    assert corpus_pipeline.STAGES[3][1](spark, out, SF).columns == names


OTHER = "lune soleil fenetre maison jardin riviere montagne silence lumiere chemin".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _corpus():
    rnd = random.Random(41)
    line = lambda of, n: " ".join(rnd.choice(of) + rnd.choice(["", "s", "ed", "ly"]) for _ in range(n))
    items = [(k, line(WORDS, n)) for k, n in enumerate((40, 25, 12, 6))]
    shared = [line(WORDS, 12) for _ in range(4)]
    rows = []
    for i in range(40):
        of, lang = (WORDS, "en") if i % 2 else (OTHER, "fr")
        text = [line(of, rnd.randint(9, 30)) for _ in range(rnd.randint(3, 7))]
        if i % 5 == 0:
            text.insert(1, rnd.choice(shared))
        if i % 8 == 3:
            text.insert(2, f"{line(WORDS, 4)} {items[i % 4][1]} {line(WORDS, 3)}")
        rows.append([i, "\n".join(text), lang if i % 9 else None, "s", 1])
    for i in range(100, 112):  # copies, with a word changed at the head of each line
        source = rows[i - 100][1].split("\n")
        rows.append([i, "\n".join(rnd.choice(WORDS) + x[x.index(" ") :] for x in source) if i % 3 else "\n".join(source), "en", None, None])
    rows += [[None, line(WORDS, 20), "en", "s", 3], [None, None, None, None, None], [200, None, "en", "s", None], [201, "", "en", "s", 0], [202, " \n ", "en", "s", 3], [203, "123 456", "en", "s", 7]]
    rows += [rows[3][:], [5, line(WORDS, 30), "en", "other", 9], [204, "x", "en", "s", 1], [205, "x", "en", "s", 1], [206, rows[7][1].split("\n")[0], "en", "s", 1]]
    rows += [[207, "\x01\x02\x03\x04\x05é\x06\x07\x0e\x0f", "en", "s", 1], [208, line(WORDS, 6000), "en", "s", 1]]
    return rows, items


def _plain_run(rows, items):
    kept = {}
    for i, t, lang, *_ in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 3 != 1 and t is not None and lang is not None:
            kept.setdefault(lang, []).append(t.encode())
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "") and min(_plain_bits(x, r[1].encode(), language_id.ORDER) for x in kept.values()) <= 8 * len(r[1].encode())]
    # lines: rows by (key, place), a null key first
    place = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    drops = _plain_lines([(n, rows[k][1]) for n, k in enumerate(place)])
    out = []
    for n, k in sorted(enumerate(place), key=lambda x: x[1]):
        lines = rows[k][1].split("\n")
        left = "\n".join(x for p, x in enumerate(lines) if (n, p) not in drops)
        if left.strip() or not any(d == n for d, _ in drops):
            out.append((rows[k][0], left, len(left)))
    # near duplicates
    prints = [_plain_fingerprint(t) for _, t, _ in out]
    root = list(range(len(out)))
    for a in range(len(out)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = root[a], root[b]
                root = [y if r == x else r for r in root]
    least = {}
    for r, (i, _, _) in zip(root, out, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    groups = {}
    for r, d in zip(root, out, strict=True):
        if d[0] is not None and d[0] == least[r]:
            groups.setdefault(r, set()).add(d[1])
    assert all(len(g) == 1 for g in groups.values())  # else the hash of the text decides
    out = sorted({d for r, d in zip(root, out, strict=True) if d[0] is not None and d[0] == least[r]}) + [d for d in out if d[0] is None]
    bad = {i for i, _ in _plain_passages([(k, t) for k, (_, t, _) in enumerate(out)], items, decontamination.WIDTH)}
    return [d for k, d in enumerate(out) if k not in bad]


def _written(spark, path, rows, items):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_run(spark, tmp_path):
    rows, items = _corpus()
    want = _plain_run(rows, items)
    got = corpus_pipeline.run(spark, _written(spark, tmp_path, rows, items)).collect()
    assert 20 < len(want) < len(rows) - 10
    library = sentencepiece_codec.Codec(open(sentencepiece_codec.model_path(), "rb").read()).library
    shown = lambda i: -1 if i is None else i
    expected = []
    for i, t, _ in want:
        ids = library.encode(t, add_bos=True, add_eos=True)
        expected.append((shown(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted((shown(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(expected)


def test_run_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, _written(spark, tmp_path / "none", [], [])).count() == 0
    rows, _ = _corpus()
    assert corpus_pipeline.run(spark, _written(spark, tmp_path / "no_items", rows[:6] + [[1, None, None, None, None]], [])).count() == 6


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.SQL[name])
    cols = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF).select(*cols).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
    assert np.isfinite(len(got))
