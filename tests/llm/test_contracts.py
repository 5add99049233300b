"""Contract queries against SQL, and the rest against brute force, on the small tables."""

import functools
import hashlib
import random
import sys
from collections import Counter
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from compare import duck_rows, spark_rows
from edge import BASE, LONG, ROWS, frame
from pyspark.sql import functions as F

from lanewise.llm import chat, decontaminate, jaccard_join, quality_knn, quality_rules, queries, sentencepiece_scan, suffix_dedup, tokens, toxicity, warc
from lanewise.llm.common import stage


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == duck_rows(queries.SQL[name], sf_dir)


def texts(spark, sf_dir):
    return [(r[0], r[1] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


# 1 WARC


def test_warc_rejects_magic_in_payloads(spark, tmp_path):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:lanewise:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "u", inner), (2, None, "x" * 200), (3, "u\r\nv", "x" * 200), (None, "u", "x" * 200), (4, "u", None), (4, "u", "WARC/1.1\r\nWARC/1.1\r\n"), (2, "u", "x" * 200), (5, "u", inner * 50), (6, "é", "é" * 99)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"))
    for split in ("128m", "400"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = warc.read_archives(spark, str(tmp_path / "w"), with_payload=True)
        found = Counter((r["record_type"], bytes(r["payload"]).decode()) for r in got.collect())
        want = Counter(("response", h or "") for k, _, h in rows if not (k == 3)) + Counter([("revisit", "")])
        assert found == want
        out = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.resolve_revisits(warc.read_archives(spark, str(tmp_path / "w"))).collect()}
        assert (3, "revisit", 2, 200) in out and (None, "response", None, 200) in out and (99, "response", None, 3) not in out and (6, "response", None, 198) in out
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")


def test_warc_of_one_payload_and_of_ids_that_are_no_numbers(spark, tmp_path):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 > 0, F.lit("error page " * 20)).otherwise(F.concat(F.lit("own " * 40), "id")).alias("html"))
    warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.resolve_revisits(warc.read_archives(spark, str(tmp_path / "w"))).groupBy("record_type", "refers_to", "payload_bytes").count().collect()
    assert {r[:3]: r[3] for r in map(tuple, got) if r[0] == "revisit"} == {("revisit", 1, 220): 1999} and sum(r[3] for r in got) == 3000
    with pytest.raises(TypeError, match="integer"):
        warc.write_archives(pages.withColumn("page_id", F.col("page_id").cast("string")), str(tmp_path / "x"))


def test_warc_damaged_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", "p" * k) for k in range(1, 6)], "page_id long, url string, html string").coalesce(1).orderBy("page_id")
    warc.write_archives(pages, str(tmp_path / "w"))
    part = next((tmp_path / "w").glob("part-*"))
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc").write_bytes(part.read_bytes()[:-40])
    (tmp_path / "cut" / "b.warc").write_bytes(b"junk" + part.read_bytes())
    assert {r["payload_bytes"] for r in warc.read_archives(spark, str(tmp_path / "cut")).collect()} == {1, 2, 3, 4}
    import gzip

    (tmp_path / "gz").mkdir()
    (tmp_path / "gz" / "a.warc.gz").write_bytes(gzip.compress(part.read_bytes()[:300]) + gzip.compress(part.read_bytes()[300:]))
    assert warc.read_archives(spark, str(tmp_path / "gz")).count() == 5
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.resolve_revisits(warc.read_archives(spark, str(tmp_path / "none"))).count() == 0


def test_warc_headers_run_on(spark, tmp_path):
    odd = ["v" * 100_000, "http://x/WARC/1.1", "WARC/1.1", "http://x/WARC/1.1 WARC/1.1", "u"]
    rows = [(k, odd[k] if k < 5 else f"http://x/{k % 7 * 'y'}/WARC/1.1", f"p{k}") for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).orderBy("page_id")
    warc.write_archives(pages, str(tmp_path / "w"))
    record = b"WARC/1.1\r\nContent-Length: 1\r\nWARC-Type: resource\r\nWARC-Target-URI: WARC/1.1\r\nX-Y: WARC/1.1\r\n\r\nz\r\n\r\n"
    (tmp_path / "last").mkdir()
    (tmp_path / "last" / "a.warc").write_bytes(record * 12)
    try:
        for split in ("128m", "1999", "60"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            if split != "60":
                got = warc.read_archives(spark, str(tmp_path / "w"), with_payload=True).collect()
                assert sorted((int(r["record_id"].split(":")[-1][:-1]), r["target_uri"], bytes(r["payload"]).decode()) for r in got) == rows
            last = warc.read_archives(spark, str(tmp_path / "last"), with_payload=True).collect()
            assert [(r["record_type"], r["target_uri"], bytes(r["payload"])) for r in last] == [("resource", "WARC/1.1", b"z")] * 12
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")


def test_warc_pages_that_share_an_id(spark, tmp_path):
    rows = [(2, "u", "a" * 200), (2, "v", "b" * 300), (3, None, "b" * 300), (4, "w", "a" * 200), (2, "u", "a" * 200), (1, "x", "c" * 50), (1, "x", "c" * 50)]
    spark.createDataFrame([(k, u, h) for k, u, h in rows], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    pages = spark.read.parquet(str(tmp_path / "pages.parquet"))
    warc.write_archives(pages, str(tmp_path / "w"))
    want = sorted((k, len(h), hashlib.sha256(h.encode()).hexdigest(), "revisit" if k > 2 else "response", str(2 if k > 2 else None)) for k, _, h in rows)
    try:
        for split in ("128m", "300"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            got = warc.resolve_revisits(warc.read_archives(spark, str(tmp_path / "w"))).collect()
            assert sorted((*r[:4], str(r[4])) for r in got) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted((*r[:4], str(r[4])) for r in con.execute(warc.OP1_SQL).fetchall()) == want


# 2 Chat


def best_path(seen, start, move, emit):
    score, back = start + emit[:, seen[0]], []
    for o in seen[1:]:
        step = score[:, None] + move
        back.append(step.argmax(0))
        score = step.max(0) + emit[:, o]
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], score.max()


def test_viterbi_equals_one_pass():
    rng = np.random.RandomState(2)
    log = lambda *shape: np.log(rng.dirichlet(np.ones(shape[-1]), shape[:-1]))
    model = log(chat.N_STATES), log(chat.N_STATES, chat.N_STATES), log(chat.N_STATES, chat.N_OBSERVED)
    seen = [rng.randint(0, chat.N_OBSERVED, n).tolist() for n in (1, 9, 3, 9, 40, 1, 2)]
    assert chat.viterbi(seen, model) == [best_path(o, *model)[0] for o in seen]
    for o in seen[1:5]:
        parts = [o[k : k + 2] for k in range(0, len(o), 2)]
        steps = chat.bounds([chat.transfer(x, model) for x in parts], chat.N_STATES, None)
        assert sum((chat.trace(x, a, b, model) for x, (a, b) in zip(parts, steps, strict=True)), []) == best_path(o, *model)[0]


def turns_by_hand(rows, learn):
    """rows: (conv_id, turn, text, state). One pass over each conversation, with counts of its own."""
    talks = {}
    for c, t, text, state in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1])):
        talk = talks.setdefault(c, [])
        for i, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            talk.append((line, state if i == 0 or state is None else state | 1))
    start, move, emit = np.ones(6), np.full((6, 6), 0.5), np.full((6, 33), 0.05)
    for k in range(3):
        start[2 * k + 1] = move[:, 2 * k + 1] = 0.01
        move[2 * k, 2 * k + 1] = move[2 * k + 1, 2 * k + 1] = 1
        emit[2 * k, 8 * k + 8 : 8 * k + 16] += 5
        emit[2 * k + 1, :8] += 5
        emit[2 * k + 1, 32] += 5
    codes = {}
    for c, talk in talks.items():
        codes[c] = [chat.observe(line, i > 0 and not talk[i - 1][0].strip()) for i, (line, _) in enumerate(talk)]
        if learn(c):
            known = [s for _, s in talk]
            if known[0] is not None:
                start[known[0]] += 1
            for s, o in zip(known, codes[c], strict=True):
                if s is not None:
                    emit[s, o] += 1
            for x, y in zip(known, known[1:], strict=False):
                if x is not None and y is not None:
                    move[x, y] += 1
    for x in range(6):
        for j in range(3):
            if x // 2 != j:
                move[x, 2 * j + 1] = 1e-9
    model = [np.log(x / x.sum(axis=-1, keepdims=True)) for x in (start, move, emit)]
    out = []
    for c, talk in talks.items():
        turns = []
        for (line, _), s in zip(talk, best_path(codes[c], *model)[0], strict=True):
            if s % 2 == 0 or not turns:
                turns.append((len(turns) + 1 if s % 2 == 0 else 0, chat.ROLES[s // 2], [chat.MARKER.sub("", line, count=1) if s % 2 == 0 and chat.MARKER.match(line) else line]))
            else:
                turns[-1][2].append(line)
        for n, role, lines in turns:
            while len(lines) > 1 and not lines[-1].strip():
                lines.pop()
            out.append((str(c), n, role, len(lines), "\n".join(lines)))
    return sorted(out)


def turns_of(df):
    return sorted((str(r["conv_id"]), *r[1:5]) for r in df.collect())


def test_chat_query_by_hand(spark, sf_dir):
    import zlib

    raw = [tuple(r) for r in chat.transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet")).select("conv_id", "turn", "text", "state").collect()]
    learn = lambda c: zlib.crc32(str(c).encode()) % 2 == 0
    want = turns_by_hand(raw, learn)
    assert turns_of(chat.op2_chat_formatting(spark, sf_dir)) == want
    given = spark.createDataFrame(raw, "conv_id long, turn long, text string, state int")
    even = F.crc32(F.col("conv_id").cast("string")) % 2 == 0
    assert turns_of(chat.parse(given, even, chunk=2)) == want
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        assert turns_of(chat.parse(given, even, chunk=5)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_chat_hot_conversation(spark):
    """Rows without conversation or place, a third of them the same, and one piece of very many lines."""
    rows = [(None, None, "User: so?\nwell", None)] * 300 + [(None, None, f"Assistant: {k}\n\nmore {k}", None) for k in range(600)] + [(1, 0, "User: hi\n" + "line\n" * 20_000, None), (1, 1, "Assistant: yes", None), (2, 0, "", None)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, text string, state int")
    chunks = chat.chunked(given, 50)
    assert chunks.agg(F.max(F.size("lines"))).first()[0] == 50 and chunks.filter("conv_id IS NULL").select("seg").distinct().count() > 1
    got = chat.parse(given, F.lit(True), 50)
    by = {(r["conv_id"], r["role"]): (r["n"], r["lines"]) for r in got.groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.sum("n_lines").alias("lines")).collect()}
    assert by[None, "user"] == (300, 600) and by[None, "assistant"] == (600, 1800) and by[1, "user"] == (1, 20_001) and by[1, "assistant"] == (1, 1)


def test_chat_edges(spark):
    rows = [(1, 0, "user", "Hi there?"), (1, 1, "assistant", "Hello.\nHow are you?"), (1, 1, "assistant", "Hello.\nHow are you?"), (None, None, None, None), (2, 0, "odd", "text"), (3, 0, "system", "")]
    out = chat.parse(chat.transcripts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), F.lit(True))
    got = out.collect()
    assert sum(r["n_lines"] for r in got) == 8 and {r["conv_id"] for r in got} == {1, 2, 3, None}
    text = "User: hi\n\nAssistant: yes\n\nmore\n\nUser: bye\n"
    lines = [(1, 0, k, s, "x", None) for k, s in enumerate(text.split("\n"))]
    schema = "conv_id long, turn long, line int, text string, seen string, state int"
    whole = spark.createDataFrame([(1, text)], "conv_id long, text string")
    for given in (whole, spark.createDataFrame(lines, schema)):
        for chunk in (chat.CHUNK, 1, 2):
            got = [(r["role"], r["content"], r["n_lines"]) for r in chat.parse(given, F.lit(True), chunk).orderBy("turn_no").collect()]
            assert got == [("user", "hi", 1), ("assistant", "yes\n\nmore", 3), ("user", "bye", 1)]
    assert chat.parse(whole.limit(0), F.lit(True)).count() == 0
    raw = chat.transcripts(spark.createDataFrame([(c, t, "user", f"one {c}\n\ntwo {t}") for c in range(8) for t in range(5)], "conv_id long, turn long, role string, text string"))
    assert set(raw.columns) == {"conv_id", "turn", "text", "state"} and 0 < raw.filter("text LIKE '%\n'").count() < 40


def test_roles_of_held_out_conversations(spark, sf_dir):
    """Roles are learnt from conversations of even hashes; of the others (52 in the next larger table) most come back whole."""
    import zlib

    sf_dir = sf_dir.replace("sf0.001", "sf0.01")

    truth, got = {}, {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        truth.setdefault(r["conv_id"], []).append(r["role"])
    for r in chat.op2_chat_formatting(spark, sf_dir).orderBy("conv_id", "turn_no").collect():
        got.setdefault(r["conv_id"], []).append(r["role"])
    held = [c for c in truth if zlib.crc32(str(c).encode()) % 2]
    right = sum(got[c] == truth[c] for c in held)
    assert len(held) >= 50 and right / len(held) >= 0.9
    assert abs(sum(len(got[c]) for c in held) - sum(len(truth[c]) for c in held)) <= 0.05 * sum(len(truth[c]) for c in held)


# 3 SentencePiece


UNBROKEN = ["x" * 3000, "日本語テキスト" * 500, "abcdefghij" * 300 + " and words " * 200 + "k" * 900 + "  \n" + "é▁" * 700, " " * 2000, "ab" * 400 + " tail", "the quick " * 400]


def test_ids_do_not_depend_on_chunks(spark):
    m = sentencepiece_scan.pieces(sentencepiece_scan.DEFAULT_MODEL)
    docs = frame(spark, [*ROWS, *((100 + k, t) for k, t in enumerate(UNBROKEN))]).withColumnsRenamed({"items": "text_key", "spans": "digest", "n_words": "n_tokens"})
    for chunk in (16_384, 700, 100):
        got = sentencepiece_scan.decode(sentencepiece_scan.encode(docs, chunk=chunk)).collect()
        assert len(got) == len(ROWS) + len(UNBROKEN) and all(r["decoded"] == (r["text"] or "") and r["text_key"] == "kept" for r in got)
        for r in got:
            assert r["ids"] == (m.encode(" " + r["text"]) if r["text"] else [])
    out = sentencepiece_scan.digest(sentencepiece_scan.encode(docs))
    assert out.columns.count("n_tokens") == 1 and out.filter("round_trip AND digest = 'n'").count() == len(ROWS) + len(UNBROKEN)
    assert sentencepiece_scan.encode(docs.limit(0)).count() == 0


def test_digests_by_hand(spark, sf_dir):
    m = sentencepiece_scan.pieces(sentencepiece_scan.DEFAULT_MODEL)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["round_trip"]) for r in sentencepiece_scan.op3_sentencepiece(spark, sf_dir).collect()}
    for d, t in texts(spark, sf_dir):
        ids = whole_search(m, " " + t) if t else []
        assert got[d] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), True)
        if len(t) < 500 and sentencepiece_scan.BLANK not in t:  # its 32-bit sums are exact up to here
            assert ids == (m.lib.encode(" " + t) if t else [])


def whole_search(m, text):
    """Ids of a whole text by one plain search, the longest last piece first among equal ones."""
    vocabulary = {p: (int(m.gain[k]), k) for k, p in enumerate(m.plain) if k > 2 and k not in m.byte_of}  # 0 to 2 are control signs
    best, back = [0] + [None] * len(text), [None] * (len(text) + 1)
    for v in range(1, len(text) + 1):
        for p in range(max(0, v - m.longest), v):
            weight, k = vocabulary.get(text[p:v], (m.unknown if v == p + 1 else None, None))
            if weight is not None and (best[v] is None or best[p] + weight > best[v]):
                best[v], back[v] = best[p] + weight, (p, k)
    ids, v = [], len(text)
    while v:
        p, k = back[v]
        ids += [k] if k is not None else [m.id_of_byte[b] for b in reversed(text[p].encode())]
        v = p
    return ids[::-1]


def test_both_searches_agree(spark, sf_dir):
    """The library and the search by matrices give the same ids, ties included, of every distinct unit of the table."""
    m = sentencepiece_scan.pieces(sentencepiece_scan.DEFAULT_MODEL)
    units = {u for _, t in texts(spark, sf_dir) for u in sentencepiece_scan.UNIT.findall(" " + t)} | {" eronou$$$", " queenç$$$", " " * 300, "abc" * 160}
    assert len(units) > 2000
    n = m.longest
    entry = np.full(n, sentencepiece_scan.NONE)
    entry[0] = 0
    for u in units:
        w, ids = sentencepiece_scan.edges(m, u, len(u))
        f = sentencepiece_scan.forward(w[:, None], entry[None, None])[:, 0, 0]
        assert sentencepiece_scan.trace(m, u, w, ids, f, entry, [len(u)])[0][1] == m.encode(u), u


def test_every_chunk_of_a_giant_text_has_a_matrix(spark):
    m = sentencepiece_scan.pieces(sentencepiece_scan.DEFAULT_MODEL)
    n = m.longest
    rng = random.Random(8)
    plain = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(12_000))
    long = {"words": plain, "unbroken": plain.replace(" ", "")[:9_000], "mixed": plain[:5_000] + "日本" * 3_000 + plain[:5_000] + " " * 900}
    for chunk in (700, 16_384):
        far = spark.createDataFrame(list(long.items()), "text_key string, text string")
        chunks = sentencepiece_scan.matrices(far, chunk=chunk)
        for key, text in long.items():
            found = sorted(chunks.filter(F.col("text_key") == key).collect(), key=lambda r: r["k"])
            assert [r["k"] for r in found] == list(range(-(-(len(text) + 1) // chunk))) and all(len(r["t"]) == n * n for r in found)
            mats = [np.asarray(r["t"]).reshape(n, n) for r in found]
            if key == "words" and len(mats) > 1:  # cuts fall inside units
                assert any((a[0, 1:] > sentencepiece_scan.NONE // 2).any() for a in mats)
            ids = whole_search(m, " " + text)
            total = functools.reduce(sentencepiece_scan.product, mats)
            assert total[0, 0] == m.gain[ids].sum() and (total[0, 1:] <= sentencepiece_scan.NONE // 2).all()
            pairs = [sentencepiece_scan.product(a, b) for a, b in zip(mats[::2], mats[1::2])] + ([mats[-1]] if len(mats) % 2 else [])
            assert (functools.reduce(sentencepiece_scan.product, pairs)[0, 0] == total[0, 0]).all()
        got = {r["text_key"]: r["ids"] for r in sentencepiece_scan.encode(far, chunk=chunk).collect()}
        assert all(got[key] == whole_search(m, " " + text) for key, text in long.items())


@pytest.mark.parametrize("text", ["a" * 300, "abcdef" * 60, "日本語" * 100 + "xyz", "\n\nx" * 90])
def test_transfer_matrices(text):
    m = sentencepiece_scan.pieces(sentencepiece_scan.DEFAULT_MODEL)
    n = m.longest
    score = [0] + [sentencepiece_scan.NONE] * len(text)
    w, _ = sentencepiece_scan.edges(m, text, len(text))
    vocabulary = {p: k for k, p in enumerate(m.pieces) if k not in m.byte_of}
    for v in range(1, len(text) + 1):
        for p in range(max(0, v - n), v):
            k = vocabulary.get(text[p:v])
            weight = round(m.score[k] * sentencepiece_scan.SCALE) if k is not None else m.unknown if v == p + 1 else None
            assert weight is None or weight == w[v - p - 1, p]
            score[v] = score[v] if weight is None else max(score[v], score[p] + weight)
    for c in (33, 100):
        at = list(range(0, len(text), c))
        mats = sentencepiece_scan.transfers(m, [text[k : k + c + n] for k in at], [min(c, len(text) - k) for k in at])
        whole = mats[0]
        for t in mats[1:]:
            whole = sentencepiece_scan.product(whole, t)
        assert whole[0, 0] == score[-1]


# 4 Token counts


def test_histogram_by_brute_force(spark, sf_dir):
    counts = [r["n_tokens"] for r in tokens.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()]
    hist = tokens.op4_token_counts(spark, sf_dir)
    for r in hist.collect():
        k = r["n_tokens"]
        assert r["n_docs"] == counts.count(k) and r["n_longer"] == sum(c > k for c in counts) and r["kept_tokens"] == sum(min(c, k) for c in counts)
        assert r["lost_tokens"] == sum(max(0, c - k) for c in counts) and abs(r["share"] - sum(c <= k for c in counts) / len(counts)) < 1e-12
    at = {r["context"]: r for r in tokens.at_limits(hist, [1, 512, 10**6]).collect()}
    assert at[512]["kept_tokens"] == sum(min(c, 512) for c in counts) and at[10**6]["n_longer"] == 0
    assert tokens.quantiles(hist, [0.5]).first()[0] == sorted(counts)[(len(counts) - 1) // 2]
    edge = tokens.token_counts(frame(spark)).collect()
    assert len(edge) == len(ROWS) and sum(r["n_tokens"] == 0 for r in edge) == 3
    assert tokens.length_histogram(tokens.token_counts(frame(spark).limit(0))).count() == 0


def test_long_runs_of_white_space(spark):
    import random

    encoding = tokens._encoding(tokens.DEFAULT_RANKS)
    rng, n = random.Random(4), tokens.RUN
    kinds = [" ", "\n", " \n\t", "\t\n\x0b\x0c\r \x85\xa0\u1680\u2003\u2028\u3000"]
    for k in range(120):
        size = 100_000 if k % 20 == 0 else rng.choice([n - 1, n, n + 1, 2 * n, rng.randint(n, 3 * n)])
        run = "".join(rng.choices(rng.choice(kinds), k=size))
        text = rng.choice(["", "ab", "x.", "it's", "9", " "]) + run + rng.choice(["", "w", "9", ".", "'s", "日", "w" + run[::-1]])
        assert tokens.count_tokens(encoding, text) == len(encoding.encode_ordinary(text))
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "a" + "\n" * 1_000_000 + "b")], "doc_id long, text string")
    got = {r[0]: r[1] for r in tokens.token_counts(docs).collect()}
    assert got[1] == 1_000_000 and got[2] > 1000


# 5 Jaccard join


def test_join_by_brute_force(spark):
    rows = list(ROWS) + [(100 + k, " ".join(f"w{k % 3}x{i}" for i in range(80)) + f" end{k}") for k in range(12)]
    sets = [set(jaccard_join.shingles(t or "").tolist()) for _, t in rows]
    near = lambda a, b: bool(a and b) and 10 * len(a & b) >= 8 * len(a | b)
    want = sorted((str(d), sum(near(a, b) for j, b in enumerate(sets) if j != i)) for i, ((d, _), a) in enumerate(zip(rows, sets, strict=True)))
    got = jaccard_join.jaccard_join(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in got) == want
    by = {r["doc_id"]: r for r in got}
    assert by[3]["group_id"] == 1 and by[2]["class_id"] == 1 and by[5]["group_id"] == 5 and by[7]["class_id"] == by[8]["class_id"] == 7 and by[10]["group_id"] == 9
    assert by[111]["group_id"] == 102 and jaccard_join.jaccard_join(frame(spark).limit(0)).count() == 0


def test_components_of_stars_and_paths(spark):
    from lanewise.llm.components import components

    edges = [(0, k) for k in range(1, 400)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000), (2001, 2000), (2000, 2001)] + [(3000 + k, 3999) for k in range(50)]
    got = {r["v"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(400)} | {1000 + k: 1000 for k in range(61)} | {2000: 2000, 2001: 2000} | {3000 + k: 3000 for k in range(50)} | {3999: 3000}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_differences_count_like_whole_sets():
    rng = np.random.RandomState(4)
    first = np.unique(rng.randint(0, 300, 120)).astype(np.uint64)
    sets = [np.unique(np.concatenate([first[rng.rand(len(first)) < 0.93], rng.randint(300, 330, 4).astype(np.uint64)])) for _ in range(30)]
    apart = [np.concatenate([np.setdiff1d(first, s), np.setdiff1d(s, first)]) for s in sets]
    copies = rng.randint(1, 5, 30)
    whole = jaccard_join.links_within(sets, copies, None, Fraction(8, 10))
    less = jaccard_join.links_within(apart, copies, None, Fraction(8, 10), np.array([len(s) for s in sets]), np.array([len(np.setdiff1d(first, s)) for s in sets]), len(first))
    assert whole[0].tolist() == less[0].tolist() and whole[1].tolist() == less[1].tolist() and whole[0].min() < whole[0].max()


def test_blocks_count_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    rows = [(k, " ".join(f"w{i}" for i in range(60)) + f" tail{k}") for k in range(40)]
    got = jaccard_join.jaccard_join(frame(spark, rows)).collect()
    assert {(r["n_links"], r["group_id"]) for r in got} == {(39, 0)}


def test_forest_shortens_prefixes():
    assert jaccard_join.choose_depth({0.99: 100}, 0.8) == jaccard_join.DEPTH
    assert jaccard_join.choose_depth({0.8: 100, 0.99: 10}, 0.8) < jaccard_join.DEPTH
    rng = np.random.RandomState(1)
    found = 0
    for _ in range(60):
        both = rng.randint(0, 2**62, 800).astype(np.uint64)
        a, b = (np.sort(np.concatenate([both, rng.randint(0, 2**62, 100).astype(np.uint64)])) for _ in range(2))
        x, y = (np.frombuffer(jaccard_join.signature(s), ">u4").reshape(jaccard_join.TREES, jaccard_join.DEPTH) for s in (a, b))
        found += bool((x[:, :5] == y[:, :5]).all(axis=1).any())
    assert found == 60


def test_links_within():
    a = [np.arange(k, 100 + k, dtype=np.uint64) for k in (0, 5, 40, 41)]
    links, label = jaccard_join.links_within(a, np.array([1, 2, 3, 4]), None, Fraction(8, 10))
    assert links.tolist() == [2, 1, 4, 3] and label.tolist() == [0, 0, 2, 2]


# 6 Quality rules


def test_rules(spark):
    out = quality_rules.quality_cascade(frame(spark)).collect()
    assert len(out) == len(ROWS)
    by = {r["doc_id"]: r for r in out if r["doc_id"]}
    assert by[4]["n_words"] == 0 and by[4]["base_failed"] and not by[4]["kept"]
    assert by[14]["n_repeat_words"] == 12 and by[14]["n_words"] == 12
    w = LONG.split()
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    assert by[9]["n_repeat_words"] == len(hit) and by[9]["n_words"] == len(w)
    assert quality_rules.order({"a": (1.0, 0.5), "b": (0.1, 0.4), "c": (1.0, 0.0)}) == ["b", "a", "c"]
    assert quality_rules.quality_cascade(frame(spark).limit(0)).count() == 0


def test_rules_run_without_python(spark, sf_dir):
    plan = quality_rules.op6_quality_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# 7 Decontamination


def test_spans_and_slices(spark, sf_dir):
    bench = spark.createDataFrame([(1, "Alpha, beta-gamma"), (2, None), (3, "!!"), (None, "zulu"), (4, " ".join(f"k{i}" for i in range(12))), (4, "x")], "item_id long, text string")
    rows = [(1, "é ALPHA  beta gamma."), (2, "k0 " + " ".join(f"K{i}" for i in range(2, 12)) + " k0"), (3, " ".join(f"K{i}" for i in range(11))), (4, None), (5, "Zulu"), (3, " ".join(f"K{i}" for i in range(11)))]
    for size in (4_000_000, 10):
        got = sorted(decontaminate.decontaminate(frame(spark, rows), bench, max_bytes=size).collect(), key=lambda r: r["doc_id"])
        assert [(r["n_words"], r["n_hit"], r["items"]) for r in got] == [(4, 3, ["1"]), (12, 10, ["4"]), (11, 11, ["4"]), (11, 11, ["4"]), (0, 0, []), (1, 1, [])]
        one = got[0]
        s = one["spans"][0]
        assert "é ALPHA  beta gamma.".encode()[s["start"] : s["stop"]] == b"ALPHA  beta gamma" and one["items"] == ["1"] and one["n_hit"] == 3
        assert got[-1]["n_hit"] == 1 and got[-1]["items"] == [] and got[-2]["n_words"] == 0
    whole = decontaminate.decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), max_bytes=2000)
    one = decontaminate.op7_decontamination(spark, sf_dir)
    assert sorted(whole.select("doc_id", "n_hit", "n_items").collect()) == sorted(one.select("doc_id", "n_hit", "n_items").collect())
    assert decontaminate.decontaminate(frame(spark, rows), bench.limit(0)).filter("n_hit > 0").count() == 0


def test_spans_do_not_depend_on_slices(spark):
    words = [f"m{i}" for i in range(40)]
    items = [(k, " ".join(words[a:b])) for k, (a, b) in enumerate([(0, 12), (5, 20), (18, 30), (33, 36), (36, 40)])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, ", ".join(words)), (2, "Ä " + " ".join(words[:12]) + " Ö " + " ".join(words[18:30])), (3, " ".join(words[3:9]))]
    found = []
    for size in (4_000_000, 100, 1):
        out = decontaminate.decontaminate(frame(spark, rows).withColumn("found", F.lit(7)), bench, max_bytes=size)
        assert {r["found"] for r in out.collect()} == {7}
        found.append(sorted((r["doc_id"], r["n_hit"], r["items"], [tuple(s) for s in r["spans"]]) for r in out.collect()))
    assert found[0] == found[1] == found[2]
    assert [len(r[3]) for r in found[0]] == [2, 2, 0] and found[0][0][3][0] == (0, len(", ".join(words[:30])))


# 8 Suffix dedup


def dedup_by_hand(rows, length=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1 if d is not None else 0):
            first[b[p : p + length]] = min(first.get(b[p : p + length], d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1 if d is not None else 0):
            if first[b[p : p + length]] < d:
                gone[p : p + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out.append((str(d), len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


def dedup_rows(df):
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    got = df.select("doc_id", size, size - F.octet_length("kept"), F.size("spans"), F.sha2("kept", 256)).collect()
    return sorted((str(r[0]), *r[1:]) for r in got)


def test_dedup_by_brute_force(spark, sf_dir):
    got = sorted((str(r[0]), *r[1:]) for r in suffix_dedup.op8_suffix_array_dedup(spark, sf_dir).collect())
    assert got == dedup_by_hand(texts(spark, sf_dir))


def test_dedup_edges(spark):
    rows = [*ROWS, (20, "a" * 300), (21, "a" * 400), (22, "ab" * 200), (20, "b" * 120 + BASE), (23, "a" * 49), (24, BASE[10:80] + "é" * 30 + BASE[100:160]), (25, "é" * 40)]
    assert dedup_rows(suffix_dedup.suffix_dedup(frame(spark, rows))) == dedup_by_hand(rows)
    assert suffix_dedup.suffix_dedup(frame(spark).limit(0)).count() == 0


@pytest.mark.parametrize("few", [1 << 14, 300])
def test_dedup_under_a_hot_prefix(spark, monkeypatch, few):
    plain = suffix_dedup.contexts
    made = []
    monkeypatch.setattr(suffix_dedup, "contexts", lambda *a: made.append(plain(*a, few=few)) or made[0])
    head = "Copyright notice of the hot source, all"  # under 50 bytes
    rows = [(k, f"{head} {k * 7919:x} {'z' * (k % 9)} own words {k} and {k * k}") for k in range(200)]
    rows += [(200 + k, f"{k}{head} rights reserved, {k:03d} tail {k % 5}") for k in range(100)]
    rows += [(400, "q" * 3000), (401, "r" + "q" * 2000 + "s" + head), (300, "q" * 60 + "t" * 60)]
    rows += [(500, "one text of a repeated row " * 4), (500, "one text of a repeated row " * 4), (501, "one text of a repeated row " * 3)] * 20
    assert dedup_rows(suffix_dedup.suffix_dedup(frame(spark, rows))) == dedup_by_hand(rows)
    held = made[0].filter("bytes IS NOT NULL").groupBy("h").agg(F.sum(F.octet_length("bytes") - 49).alias("n")).agg(F.max("n")).first()[0] or 0
    assert held <= few and (few > 300) == made[0].filter("bytes IS NULL").isEmpty()


def test_a_hot_passage_makes_a_row_for_each_run(spark, monkeypatch):
    """Strings at the edges of a passage that all documents have go as runs, not one by one."""
    plain = suffix_dedup.contexts
    made = []
    monkeypatch.setattr(suffix_dedup, "contexts", lambda *a: made.append(plain(*a, few=300)) or made[0])
    passage = "The one passage that every document of this table has somewhere in it, of more than one hundred bytes in all"
    rows = [(k, f"{k * 7919:07x} begins with its own {k * k:09d} words{passage}{k * 104729:08x} ends with others {k * 31:06d} as well") for k in range(400)]
    docs = frame(spark, rows).coalesce(2)
    assert dedup_rows(suffix_dedup.suffix_dedup(docs)) == dedup_by_hand(rows)
    told = made[0].repartition(4, "h", "c1", "salt").sortWithinPartitions("h", "c1", "c2", "salt", "doc").mapInArrow(suffix_dedup._compare(50), "doc long, tag long, s long, e long")
    # one by one they were 9,079 rows
    assert not made[0].filter("bytes IS NULL").isEmpty() and told.count() < 8 * len(rows)


def test_ranks_of_many_documents_are_spread(spark):
    head = "A licence line that very many documents begin with, over fifty bytes; "
    docs = spark.createDataFrame([(k, head + f"{k * 7919:x} own {k}") for k in range(8000)], "doc long, text string").repartition(8)
    pairs = docs.select("doc", F.lit(0).cast("long").alias("tag"), "text").mapInArrow(suffix_dedup._pairs(50, 20, False), "h long, salt int, doc long")
    assert pairs.groupBy("h").count().agg(F.max("count")).first()[0] == 8000
    assert pairs.groupBy("h", "salt").count().agg(F.max("count")).first()[0] <= 64
    got = suffix_dedup.suffix_dedup(docs.withColumnRenamed("doc", "doc_id").withColumn("marks", F.lit("m")).withColumn("cut", F.lit("c")))
    assert got.filter("kept = encode(text, 'UTF-8')").count() == 1 and got.filter("marks = 'm' AND cut = 'c'").count() == 8000
    with pytest.raises(TypeError, match="integer"):
        suffix_dedup.suffix_dedup(docs.select(F.col("doc").cast("string").alias("doc_id"), "text"))


def test_shared_ranks_over_batches():
    import pyarrow as pa

    rng = np.random.RandomState(3)
    rows, first = [], set()
    for h, d, p in sorted({(int(h), int(d), int(p)) for h, d, p in zip(rng.randint(0, 12, 90), rng.randint(0, 3, 90), rng.randint(0, 5, 90), strict=True)}):
        salt = 0 if rng.rand() < 0.8 else d + 1
        late = (h, salt, d) in first and rng.rand() < 0.7  # a late row has one of its document before it
        first.add((h, salt, d))
        rows.append((h, salt, late, d, p))
    rows.sort()  # as they are sorted; columns in any order
    want = sorted((h, d, p) for h, salt, _, d, p in rows if salt or len({x[3] for x in rows if x[0] == h and not x[1]}) > 1)
    assert any(r[2] for r in rows)
    for size in (1, 2, 7, 90):
        parts = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + size], strict=True), (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["h", "salt", "late", "doc", "tag"]) for k in range(0, len(rows), size)]
        assert sorted(tuple(r.values()) for b in suffix_dedup._shared(iter(parts)) for r in b.to_pylist()) == want


def test_rows_of_one_id_grow_in_step(spark, monkeypatch):
    """Ranks that go along with texts of one doc_id are those of each text, not of all of them."""
    plain, carried = suffix_dedup.stage, []
    monkeypatch.setattr(suffix_dedup, "stage", lambda df, label, *a: (out := plain(df, label, *a)) and (label == "shared" and carried.append(out.agg(F.sum(F.size("ranks"))).first()[0]), out)[1])
    for n in (100, 200, 400):
        texts_ = [" ".join(f"{k * 60 + w:x}word" for w in range(60)) for k in range(n)]
        rows = [(0, t) for t in texts_] + [(k + 1, t) for k, t in enumerate(texts_)]
        got = dedup_rows(suffix_dedup.suffix_dedup(frame(spark, rows)))
        assert n > 100 or got == dedup_by_hand(rows)
    assert carried[1] < 2.2 * carried[0] and carried[2] < 2.2 * carried[1]


def test_stretches_cut_anywhere(monkeypatch):
    import pyarrow as pa

    column = pa.array([BASE, "", LONG[:3000], "x" * 200])
    one = suffix_dedup.stretches(column)
    monkeypatch.setattr(suffix_dedup, "STEP", 137)
    for row, s, e, h, _, _ in (one, suffix_dedup.stretches(column)):
        covered = Counter((r, p) for r, a, b in zip(row.tolist(), s.tolist(), e.tolist(), strict=True) for p in range(a, b + 1))
        assert set(covered.values()) == {1} and len(covered) == sum(max(0, len(t.encode()) - 49) for t in column.to_pylist())


# 9 and 10 classifiers


def accuracy(spark, sf_dir, df, label):
    rows = df.filter("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").select("predicted", label).collect()
    return sum(a == b for a, b in rows) / len(rows)


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    assert accuracy(spark, sf, toxicity.op9_toxicity(spark, sf), "toxic") > 0.94
    assert accuracy(spark, sf, quality_knn.op10_quality_classifier(spark, sf), "quality") > 0.97


def test_terms_that_tell_in_pairs_only(spark):
    """Toxic is an insult with a group; each of the two is as common in clean texts, which have one of them or none."""
    rng = np.random.RandomState(8)
    rows = []
    for k in range(1600):
        toxic = k % 2
        # half of either kind has each of the words: toxic ones both or none before the label, clean ones exactly one
        has = ("zorp", "quux") if toxic else (("zorp",), ("quux",), ("zorp",), ())[rng.randint(4)]
        words = [f"w{i}" for i in rng.randint(0, 60, 25)] + list(has)
        rows.append((k, " ".join(rng.permutation(words)), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    learn = F.col("doc_id") % 5 != 0
    slots = toxicity.telling_slots(toxicity.with_slots(toxicity.labelled(docs, labels, "toxic", learn, 16_000)).select("y", "slots"))
    assert {toxicity.slot("zorp"), toxicity.slot("quux")} <= set(slots)
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels, learn).collect()}
    for label in (0, 1):
        held = [(got[k] >= 0.7) == bool(y) for k, _, y in rows if k % 5 == 0 and y == label]
        assert len(held) == 160 and sum(held) / len(held) > 0.97


def test_likelihood_ratio():
    assert toxicity.likelihood_ratio([5], [10], 50, 50)[0] == pytest.approx(0)
    p, n = 9, 10
    want = 2 * sum(o * np.log(o / e) for o, e in ((p, n / 2), (n - p, n / 2), (50 - p, 45), (50 - (n - p), 45)))
    assert toxicity.likelihood_ratio([p], [n], 50, 50)[0] == pytest.approx(want)


def test_scores_by_brute_force(spark):
    """The factorization machine's sum and the vote, recomputed row by row."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    slots, model = toxicity.fit(toxicity.labelled(docs, labels, "toxic", F.lit(True), 16_000))
    rows = toxicity.with_slots(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).select("doc_id", "slots").collect()
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels, F.lit(True)).collect()}
    w, v = model.linear.toArray(), model.factors.toArray()
    for r in rows:
        filled = set(r["slots"])
        at = [k for k, s in enumerate(slots) if s in filled]
        z = model.intercept + w[at].sum() + sum(v[i] @ v[j] for n, i in enumerate(at) for j in at[:n])
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)
    idf, basis, known, ys = quality_knn.fit(quality_knn.labelled(docs, labels, "quality", F.lit(True), 4096))
    got = {r["doc_id"]: r["score"] for r in quality_knn.quality(docs, labels, F.lit(True)).collect()}
    for d, t in texts(spark, sf)[:200]:
        x = quality_knn.weigh(quality_knn.term_counts([t]), idf)[0] @ basis
        if np.linalg.norm(x) < 1e-6:
            assert got[d] == pytest.approx(ys.mean())
            continue
        cos = [float(x @ k / np.linalg.norm(x)) for k in known]
        least = sorted(cos)[-quality_knn.NEIGHBOURS]
        near = [(max(c, 1e-6) ** 8, y) for c, y in zip(cos, ys, strict=True) if c >= least - 1e-7]
        assert got[d] == pytest.approx(sum(c * y for c, y in near) / sum(c for c, _ in near), abs=0.02)


def test_latent_vectors_span_the_leading_directions(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    sample = quality_knn.labelled(docs, labels, "quality", F.lit(True), 4096)
    idf, basis, known, _ = quality_knn.fit(sample)
    x = quality_knn.weigh(quality_knn.term_counts([r["text"] for r in sample.dropDuplicates(["doc_id"]).collect()]), idf)
    best = np.linalg.svd(x, compute_uv=False)[: quality_knn.DIMS]
    assert (np.linalg.norm(x @ basis) ** 2) > 0.97 * (best**2).sum() and np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-3)


def test_classifier_edges(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for docs, some in ((frame(spark), labels), (frame(spark), labels.limit(0)), (frame(spark).limit(0), labels)):
        for f in (toxicity.toxicity, quality_knn.quality):
            got = f(docs, some, F.lit(True)).collect()
            assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    clash = frame(spark).withColumn("score", F.lit("own"))
    assert {r["score"] for r in quality_knn.quality(clash, labels, F.lit(True), out="q").collect()} == {"own"}
    assert toxicity.toxicity(clash, labels, F.lit(True)).columns == ["doc_id", "score"]


def test_vote():
    cos = np.array([[0.9, 0.8, 0.1]], np.float32)
    assert quality_knn.vote(cos, np.array([1, 1, 0], np.float32), 2)[0] == 1.0 and quality_knn.vote(cos, np.array([0, 0, 1], np.float32), 2)[0] == 0.0
    tied = np.array([[0.5, 0.9, 0.5, 0.5]], np.float32)
    votes = {quality_knn.vote(tied[:, list(o)], np.array([1, 0, 0, 1], np.float32)[list(o)], 2)[0] for o in ((0, 1, 2, 3), (3, 2, 1, 0), (2, 0, 3, 1))}
    assert len(votes) == 1 and votes.pop() == pytest.approx(2 * 0.5**8 / (0.9**8 + 3 * 0.5**8), rel=1e-5)
