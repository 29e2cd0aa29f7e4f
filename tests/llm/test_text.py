import base64
import random
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallywise.llm import bpe, chat, decontam, langid, quality, queries, shards, toxicity
from tests.llm.helpers import documents, edge_rows, edit_distance_in, prose

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_bpe_round_trip_and_edges(spark, monkeypatch):
    rows = [*edge_rows(), (50, "it's  a\n\n test!! 'll   " * 50), (51, "日本語 テスト " * 300), (52, "\x00\x1c a\x85b  ")]
    tokens = bpe.encode(spark, documents(spark, rows, clashes=True), RANKS, public_tokenizers.PATTERN)
    got = bpe.decode(spark, tokens, RANKS, public_tokenizers.PATTERN).collect()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    key = lambda r: (str(r[0]), r[1])
    want = sorted(((i, own.encode_ordinary(t or "")) for i, t in rows), key=key)
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=key) == want
    assert all(bytes(r.decoded) in {(t or "").encode() for i, t in rows if i == r.doc_id} for r in got)
    both = bpe.round_trip(spark, documents(spark, rows), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(map(str, both)) == sorted(map(str, got))
    assert bpe.encode(spark, documents(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_chunks_keep_the_ids():
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for text in (prose(1, 3000), "a  b   c'll d!e " * 900, "x" * 5000, "é ü\n " * 2000):
        parts = list(bpe.chunks(text, 64))
        assert "".join(parts) == text
        assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_shards_by_brute_force(spark):
    rows = [(i, t) for i, t in edge_rows()] + [(100 + k, prose(k, k)) for k in range(200)]
    got = shards.assign_shards(spark, documents(spark, rows, clashes=True), shards=5).collect()
    data = sorted(((-1 if i is None else i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows))
    total, at, slots, want = sum(n for *_, n in data), 0, {}, []
    for i, crc, n in data:
        at += n
        shard = (2 * at - n) * 5 // (2 * total)
        slots[shard] = slots.get(shard, -1) + 1
        want.append((i, n, crc, shard, slots[shard]))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == sorted(want)
    assert shards.assign_shards(spark, documents(spark, [])).count() == 0


def test_shard_query(spark, sf):
    got = queries.QUERIES["op5_byte_shards"](spark, sf).groupBy("shard").agg(
        F.sum("size").alias("size"), F.max("slot").alias("last"), F.count("*").alias("n"), F.max("size").alias("most")).collect()
    mean = sum(r.size for r in got) / 16
    assert len(got) == 16 and all(r.last + 1 == r.n and abs(r.size - mean) <= max(x.most for x in got) for r in got)


def test_chats(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"),
             (4, 0, None, None), (5, None, "user", "x"), (5, 3, "user", "x"), (5, 3, "user", "x"), (None, 0, "user", "n")]
    turns += [(6, t, "user", str(t)) for t in range(1100)] + [(7, t, "user", str(t)) for t in range(700)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("block", F.lit(1))
    got = {(r.conv_id, r.part): r for r in chat.format_chats(spark, df).collect()}
    assert {c for c, _ in got} == {1, 4, 5, 6, None}
    assert got[1, 0].rendered == "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n"
    assert got[4, 0].rendered == "<|unknown|>\n<|end|>\n" and got[5, 0].n_turns == 3
    assert "".join(got[6, p].rendered for p in range(3)) == "".join(f"<|user|>\n{t}<|end|>\n" for t in range(1100))
    assert chat.format_chats(spark, df.limit(0)).count() == 0


def test_edit_distance_by_brute_force():
    r = random.Random(2)
    for _ in range(200):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 20)))
        t = "".join(r.choice("abc") for _ in range(r.randint(0, 40)))
        want = edit_distance_in(p, t)
        got = decontam.best_match(p, t, len(p) - 1)
        assert (got is None and want >= len(p)) or got[0] == want
        if got:
            assert edit_distance_in(p, t[got[1]:got[2]]) == want


def test_decontamination_by_brute_force(spark):
    r = random.Random(6)
    items = [(k, prose(500 + k, 20)) for k in range(8)] + [(8, None), (9, " "), (10, prose(500, 20).upper())]
    rows = edge_rows()
    for k in range(30):
        s = list(prose(500 + k % 8, 20))
        for _ in range(r.choice((0, 3, 6, 9, 14))):
            s[r.randrange(len(s))] = r.choice("xyz")
        rows.append((100 + k, prose(k, 5) + " " + "".join(s) + "  " + prose(k, 3)))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in decontam.contaminated(spark, documents(spark, rows, clashes=True), table).collect()}
    want = {}
    for i, t in rows:
        if i is None or i < 100:
            continue
        for n, text in items:
            p = decontam.normalise(text or "")
            d = edit_distance_in(p, decontam.normalise(t)) if p else 1
            if p and d <= int(len(p) * decontam.EDIT_SHARE):
                want[i, n] = d
    assert want and got == want
    assert decontam.contaminated(spark, documents(spark, []), table).count() == 0
    assert decontam.contaminated(spark, documents(spark, rows), table.limit(0)).count() == 0


def held_out_share(df, labels, column):
    rows = df.join(labels, "doc_id").where("held_out").select("predicted", column).collect()
    return sum(r[0] == r[1] for r in rows) / len(rows)


@pytest.mark.parametrize("op", [quality.score_quality, toxicity.score_toxicity])
def test_scorers_on_held_out_rows_and_edges(spark, op):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op(spark, docs, labels)
    assert held_out_share(got, labels, "quality" if op is quality.score_quality else "toxic") > 0.85
    odd = op(spark, documents(spark, edge_rows(), clashes=True), labels).collect()
    assert len(odd) == len(edge_rows()) and all(0 <= r.score <= 1 for r in odd)
    assert op(spark, documents(spark, []), labels).count() == 0
    assert {r.score for r in op(spark, documents(spark, edge_rows()), labels.limit(0)).collect()} == {0.5}


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95
    odd = {r.doc_id: r for r in langid.identify(spark, documents(spark, edge_rows(), clashes=True)).collect()}
    assert odd[1].lang_pred == odd[2].lang_pred == "und" and odd[4].lang_pred == "en"
    assert langid.identify(spark, documents(spark, [])).count() == 0


def test_disguises_are_read():
    counts = toxicity.np.zeros(toxicity.SYMBOLS ** 3)
    body = ("you stupid idiot pathetic loser and more words of plain text the cat sat on the mat " * 40).encode()
    s = toxicity.BYTE_SYMBOL[toxicity.np.frombuffer(body, toxicity.np.uint8)]
    toxicity.np.add.at(counts, s[:-2] * 784 + s[1:-1] * 28 + s[2:], 1)
    model = toxicity.language_model(counts)
    for typed, clean in (("stup1d", "stupid"), ("$tupid!!", "stupid"), ("l.o.s.e.r", "loser"), ("idiooot", "idiot"),
                         ("p4th3t1c", "pathetic"), ("l*ser", "loser"), ("plain", "plain"), ("id!ot", "idiot")):
        assert clean in toxicity.restored(typed, model), typed
    assert "loser" in " ".join(toxicity.spelled_out("such a l o s e r now", model)).split()
    assert toxicity.restored("12345", model) == [] and toxicity.restored("", model) == []
