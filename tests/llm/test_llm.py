"""The text operators against brute force on small tables, planted cases and odd input."""

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from epistrata.llm import common, components, licenses, mixing, near_copies, packing, paragraphs, passages, prefix, quality, registry, repetition, sharding, simhash, sketches, token_store, tokens

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " \n\t ", "one", "a b", "Ünïcode wörter überall 日本語 のテキスト", "x " * 300, "same text here again", "same text here again", "under the mit\nlicense!  CC BY-NC", "\x00\x01 nul", "no  double\tspaces \n\n"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and null ids."""
    rows = [(i if i % 5 else i + 1, t, "en", None if i % 4 == 0 else f"s{i % 3}", 0) for i, t in enumerate(ODD)]
    rows += [rows[3], (None, "no id at all here", None, None, None), (None, None, None, None, None), (77, "long " * 30000, "en", "s1", 1)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit(1)).withColumn("key", F.lit("k")).withColumn("component", F.lit(0)).withColumn("row", F.lit("r")).withColumn("score", F.lit(9))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return common.documents(spark, SF)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_components_match_union_find(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("caps", [[100, 100, 100], [1000, 10, 1], [5, 5, 2000], [0, 7, 0], [1, 1, 1000, 3, 50]])
def test_targets_fill_to_the_limits(spark, caps):
    rows = [(f"s{i}", n) for i, n in enumerate(caps)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    left, w, full = float(sum(caps)), {f"s{i}": 1 + i % 3 for i in range(len(caps))}, {}
    while True:
        rest = {s: x for s, x in w.items() if s not in full}
        over = {s for s, x in rest.items() if left * x / sum(rest.values()) > 3 * dict(rows)[s]}
        if not over:
            break
        for s in over:
            full[s] = 3.0 * dict(rows)[s]
        left = sum(caps) - sum(full.values())
    want = full | {s: left * x / sum(rest.values()) for s, x in rest.items()}
    assert all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in w)


def test_mix_reaches_targets_in_order(docs):
    rows = mixing.schedule(docs).collect()
    by = {}
    for r in rows:
        assert r.size == len(words(docs_text(docs)[r.doc_id])) and 0 <= r.taken <= 3 * r.size and r.taken == sum(c.served for c in r.copies)
        by.setdefault(r.source, [0, r.target, r.source_size])[0] += r.taken
    assert all(0 <= t - math.floor(target) < len(by) for t, target, _ in by.values())
    assert sum(t for t, *_ in by.values()) == sum(n for *_, n in by.values())
    order = [r.vfinish for r in mixing.mix(docs).collect()]
    assert order == sorted(order)


_texts = {}


def docs_text(docs):
    if not _texts:
        _texts.update({r.doc_id: r.text for r in docs.collect()})
    return _texts


def test_mixed_documents_carry_the_served_words(docs):
    plan = {(r.doc_id): r for r in mixing.schedule(docs.withColumn("doc_id", F.xxhash64("doc_id", "text"))).collect()}
    got = Counter()
    for r in mixing.mixed_documents(docs).withColumn("h", F.xxhash64("doc_id", F.lit(None))).collect():
        assert docs_text(docs)[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        got[r.doc_id] += len(words(r.text))
    assert sum(got.values()) == sum(r.taken for r in plan.values())


def brute_simhash(t, width=3):
    w = words(lower(t))
    if not w:
        return 0
    s = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_fingerprints_and_classes(docs, spark):
    base = " ".join(f"w{i}" for i in range(400))
    planted = [(10_000 + i, base if i < 3 else base.replace("w7 ", f"z{i} "), "en", "s", 1) for i in range(60)]
    d = docs.union(spark.createDataFrame(planted, SCHEMA))
    rows = d.select("doc_id", "text").collect()
    fp = {r.doc_id: brute_simhash(r.text) for r in rows}
    parent = {i: i for i in fp}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(fp), 2):
        if (fp[a] ^ fp[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.classes(d).collect()}
    assert got == {i: (fp[i], find(i)) for i in fp}
    assert len({find(10_000 + i) for i in range(60)}) == 1


def test_near_copies_against_all_pairs(spark, docs, monkeypatch):
    """Few and crowded near-copies, exact copies and texts that are too different, against the exact likeness of all pairs."""
    monkeypatch.setattr(near_copies, "BLOCK", 25)
    rng = random.Random(5)
    texts = [r.text for r in docs.where("n_chars > 600").orderBy("doc_id").limit(40).collect()]

    def changed(text, n):
        w = text.split()
        for i in rng.sample(range(len(w)), n):
            w[i] = f"q{rng.randrange(10**6)}"
        return " ".join(w)

    made = [changed(t, max(1, len(t.split()) // 60)) for t in texts] + [changed(t, len(t.split()) // 10) for t in texts]
    crowd = [changed(" ".join(f"w{i}" for i in range(400)), 2) for _ in range(90)]
    given = list(enumerate([*texts, *made, *crowd, *crowd[:3], texts[0].translate(str.maketrans(common.ASCII_LOWER, common.ASCII_UPPER)), "", None]))
    sets = [set(near_copies.shingles(t.encode().lower().split() if t else []).tolist()) for _, t in given]
    group = list(range(len(given)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    unsure = 0
    for i, a in enumerate(sets):
        for j in range(i):
            like = len(a & sets[j]) / max(1, len(a | sets[j]))
            unsure += 0.8 <= like < 0.84
            if a == sets[j] or like >= 0.8:
                group[top(i)] = top(j)
    want = {}
    for i in range(len(given)):
        want[top(i)] = min(i, want.get(top(i), i))
    kept = near_copies.deduplicated(spark.createDataFrame(given, "doc_id long, text string"))
    assert len({r.doc_id for r in kept.collect()} ^ set(want.values())) <= unsure // 10
    assert kept.where("doc_id >= 120").count() == 2  # one of the crowd, one text without words


def test_near_copies_keys_meet():
    """At a likeness of 0.85 or more nearly all pairs share a key; unlike sets share none."""
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 1 << 63, (60, 190), dtype=np.uint64)
    own = rng.integers(0, 1 << 63, (2, 60, 15), dtype=np.uint64)
    (a, x), (b, y) = (near_copies.signatures([np.r_[s, o] for s, o in zip(shared, own[i])]) for i in (0, 1))
    bucket = lambda k: set((k >> np.uint64(near_copies.SHORT)).tolist())
    assert sum(bool(bucket(i) & bucket(j)) for i, j in zip(x, y)) >= 58
    assert sum(bool(bucket(i) & bucket(j)) for i, j in zip(x, np.roll(y, 1, axis=0))) <= 1
    like = near_copies.estimated(np.bitwise_count(a ^ b).sum(axis=1), 205.0, 205.0)
    assert abs(like.mean() - 190 / 220) < 0.02


@pytest.mark.parametrize("block", [4096, 25])
def test_a_crowd_links_by_exact_likeness(spark, monkeypatch, block):
    """Every pair of a template's texts is at 0.77, so none may go; those of another are at 0.81 and are one class."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    given = []
    for at, (name, own, shared) in enumerate((("far", 26, 174), ("near", 21, 179))):
        template = [f"{name}{j}" for j in range(shared + near_copies.WIDTH - 1)]
        given += [(1000 * at + i, " ".join(template + [f"{name}own{i}x{j}" for j in range(own)])) for i in range(60)]
    sets = {i: set(near_copies.shingles(t.encode().split()).tolist()) for i, t in given}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert like(0, 1) < 0.775 and like(1000, 1001) > 0.805
    kept = near_copies.deduplicated(spark.createDataFrame(given, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [*range(60), 1000]


def test_linked_buckets_of_all_sizes():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    f = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 50, dtype=np.uint64)) for c in centre]))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(f), dtype=np.int64)), pa.array(f.view(np.int64))], names=["key", "fp"])
    edges = {tuple(e) for b in simhash._linked([batch.slice(0, 100), batch.slice(100)]) for e in zip(*b.to_pydict().values())}
    as_int = f.view(np.int64).tolist()
    near = [(a, b) for a, b in combinations(as_int, 2) if ((a ^ b) % (1 << 64)).bit_count() <= 3]

    def classes(pairs):
        p = {x: x for x in as_int}

        def find(x):
            while p[x] != x:
                x = p[x]
            return x

        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            p[y] = x
        return {x: find(x) for x in as_int}

    assert classes(edges) == classes(near)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_tokenizer(docs, name):
    enc, plain = tokens.PieceEncoder(public_tokenizers.path(name), 2_000), Tokenizer.from_file(public_tokenizers.path(name))
    texts = [t or "" for t in [*ODD, *docs_text(docs).values(), "  a", "a  b", " \n x", "e ́x", "a\tb c", "<|endoftext|> hi", "x ", "\n\nfoo\n  bar", "don't stop'll", "c\x1c d!", "İ x", "a  b", "tail \n", "a\n\n\nb\n\nc", "7 a7 77 b", "\n7", "x\n y\nz", "Ġa Ċb", "mañana ÀÉ÷×µºª", "£5 ¡ÑO! <|STARTOFTEXT|>", "It's THE 'REal (x2) ''s", "Éçrean, é'll ñ… …, <PAD> <pad>", "a'LLb 'tis 've've don't,don't"]]
    pool = ["A", "b", "'s", "'LL", "7", "é", "İ", "ß", "…", ",", "!!", "<", ">", "\u0301", "ǅ", "日", " ", " ", "\n"]
    fuzz = random.Random(3)
    texts += ["".join(fuzz.choices(pool, k=30)) for _ in range(2000)]
    for t in texts * 2:
        assert enc.encode(t) == np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(t[:50])


def test_marks_are_learnt_apart_from_words():
    """A word with many marks is encoded once; what stands in doubt is encoded whole, as the pattern says."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, plain = tokens.PieceEncoder(path), Tokenizer.from_file(path)
    text = "so" + "".join(f" zorblat{m} don't{m} x's{m} Wörter{m} 7{m}" for m in [",", ".", "!!", "$$$", "'", "'.", "_", ".%%%", "\"", "?!"])
    learnt = []
    learn = enc._learn
    enc._learn = lambda pieces: (learnt.extend(pieces), learn(pieces))
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert [p for p in learnt if "zorblat" in p] == [" zorblat"]
    for t in ["a\tb", "a  b", "a\n\nb", "a ", "a\n", "a \nb", "a\x85b", "é\xa0b", "a \u0301b", "日\u3000b", "a b\nc", "é b", "a\x1cb", "日 b", "日 "]:
        for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
            e = tokens.encoder(public_tokenizers.path(name))
            assert e._whole(t) == bool(e.odd.search(t))


def test_byte_level_words_are_kept_in_columns():
    """No piece of an even text stays as Python's object, whatever its characters; the ids are the tokenizer's, however few words are kept."""
    path, fuzz = public_tokenizers.path("byte_bpe_50k.json"), random.Random(6)
    plain = Tokenizer.from_file(path)
    pool = ["A", "b", "'s", "'LL", "'", "s", "re", "7", "42", "é", "ß", "…", "’", ",", "!!", "<", "\u0301", "日", "²", "×", "÷", "\x01", " ", " ", "\n"]
    texts = ["", "é's …'s ’s, ×'s", " a\n 's", *["".join(fuzz.choices(pool, k=fuzz.randint(1, 30))) for _ in range(3000)]]
    for kept in (100, 200_000):
        enc = tokens.PieceEncoder(path, kept)
        got = [x for i in range(0, len(texts), 500) for x in enc.encode_all(texts[i : i + 500])]
        for t, ids in zip(texts, got, strict=True):
            assert ids == np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(t)
        assert not enc.known and not enc.older


def test_letters_beyond_ascii_are_learnt_apart_from_marks():
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, plain, learnt = tokens.PieceEncoder(path), Tokenizer.from_file(path), []
    learn = enc._learn
    enc._learn = lambda pieces: (learnt.extend(pieces), learn(pieces))
    text = "so" + "".join(f" zörblaté{m}" for m in [",", ".", "!!", "$$$", "'s", "7", ""])
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert [p for p in learnt if "zörblat" in p] == [" zörblaté"]


def test_the_store_keeps_few_pieces_in_a_worker(monkeypatch):
    """What the store's encoder keeps is bounded by its own limit, and ids don't depend on it."""
    path, made = public_tokenizers.path("word_bpe_49k.json"), []
    monkeypatch.setattr(token_store, "encoder", lambda *a: made.append(tokens.PieceEncoder(*a)) or made[-1])
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words and some"])], names=["doc_id", "text"])
    rows = [list(token_store._encode(path, 1, "<u2", 1)(iter([batch])))]
    monkeypatch.setattr(token_store, "KEPT", 2)
    rows.append(list(token_store._encode(path, 1, "<u2", 1)(iter([batch]))))
    assert rows[0] == rows[1] and [e.kept for e in made] == [400_000, 2]


def test_the_store_encodes_latin_texts_together(monkeypatch):
    """Documents are encoded by bytes of text, not 128 at a time, and words of Latin texts don't stay as Python's objects; every document has the ids and chunks that it has alone."""
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, fuzz = Tokenizer.from_file(path), random.Random(4)
    pool = ["A", "b", "'s", "'LL", "'", "'re", "re", "7", "é", "ß", "Ñ", "ÿ", ",", "!!", "Wort", " ", " ", "\n", "<|endoftext|"]
    texts = [None, "", " ", "\n", "'", *["".join(fuzz.choices(pool, k=fuzz.randint(1, 300))) for _ in range(300)], "x" * 9000, " a'b" * 9000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    for block, kept in ((None, 750_000), (2_000, 60)):
        enc, sizes = tokens.PieceEncoder(path, kept), []
        encode = enc.encode_all
        enc.encode_all = lambda some: sizes.append(len(some)) or encode(some)
        monkeypatch.setattr(token_store, "encoder", lambda *a: enc)
        if block:
            monkeypatch.setattr(tokens, "BLOCK", block)
            monkeypatch.setattr(token_store, "BLOCK", block)
        rows = pa.Table.from_batches(token_store._encode(path, 1, "<u2", 1)(iter([batch]))).to_pylist()
        chunks = {c["digest"]: c["ids"] for r in rows for c in r["new"]}
        for r, t in zip(rows, texts, strict=True):
            ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u2")
            ends = token_store.cuts(ids)
            assert [chunks[d] for d in r["digests"]] == [ids[a:b].tobytes() for a, b in zip([0, *ends], ends)], t
            assert r["n_tokens"] == len(ids) and r["root"] == token_store.merkle_root(r["digests"])
        assert (len(sizes) > 20 if block else sizes == [len(texts)]) and sum(sizes) == len(texts) and not enc.known
    whole = tokens.PieceEncoder(path).encode_all([t or "" for t in texts])
    monkeypatch.setattr(tokens, "LONGEST", 100)
    assert tokens.PieceEncoder(path).encode_all([t or "" for t in texts]) == whole


def test_store_round_trip(spark, docs, odd):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for table in (docs, odd, docs.limit(0)):
        folder = common.table_path(spark, "test_store")
        token_store.write_store(table, folder, public_tokenizers.path("word_bpe_49k.json"))
        got = token_store.read_store(spark, folder).orderBy("ordinal").collect()
        want = Counter((r.doc_id, np.array(plain.encode(r.text or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes()) for r in table.collect())
        assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
        assert all(r.verified for r in got)
        ids = [r.doc_id for r in got]
        assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
        at = 0
        for r in got:
            assert r.start == at and r.n_tokens == len(r.ids) // 4
            at += r.n_tokens
        chunks = spark.read.parquet(f"{folder}/chunks")
        assert chunks.count() == chunks.select("digest").distinct().count() and spark.read.parquet(f"{folder}/manifests").count() == (len(got) > 0)


def test_a_damaged_store_is_flagged(spark, docs):
    """A chunk that is gone or altered flags the documents that use it; a recipe that is gone or altered flags its part."""
    some = docs.where("doc_id < 60")

    def store():
        folder = common.table_path(spark, "test_store")
        token_store.write_store(some, folder, public_tokenizers.path("word_bpe_49k.json"))
        return folder

    def replace(folder, table, change):
        d = spark.read.parquet(f"{folder}/{table}")
        rows = change(d.collect())
        common.delete(spark, f"{folder}/{table}")
        spark.createDataFrame(rows, d.schema).write.parquet(f"{folder}/{table}")

    whole = store()
    victim = max(spark.read.parquet(f"{whole}/recipes").collect(), key=lambda r: len(r.digests))
    lost = victim.digests[0]
    users = {r.ordinal for r in spark.read.parquet(f"{whole}/recipes").collect() if lost in r.digests}
    assert token_store.checked_parts(spark, whole).collect()[0].whole
    for change in (lambda rows: [r for r in rows if r.digest != lost], lambda rows: [(r.digest, bytes(len(r.ids))) if r.digest == lost else tuple(r) for r in rows]):
        folder = store()
        replace(folder, "chunks", change)
        got = token_store.read_store(spark, folder).collect()
        assert len(got) == some.count() and {r.ordinal for r in got if not r.verified} == users
    for change in (lambda rows: rows[1:], lambda rows: [(*r[:4], r.digests[::-1], token_store.merkle_root(r.digests[::-1])) if r.ordinal == victim.ordinal else tuple(r) for r in rows]):
        folder = store()
        replace(folder, "recipes", change)
        assert not any(r.verified for r in token_store.read_store(spark, folder).collect())


def test_store_query_reads_what_it_wrote(spark, docs):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts, at = docs_text(docs), 0
    got = {r.doc_id: r for r in registry.op3_token_store(spark, SF).collect()}
    for d in sorted(texts):
        ids = np.array(plain.encode(texts[d] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32, got[d].verified) == (at, len(ids), zlib.crc32(ids.tobytes()), True)
        at += len(ids)


def test_chunks_follow_content():
    rng = np.random.default_rng(0)
    passage, heads = rng.integers(0, 49000, 20000), [rng.integers(0, 49000, n) for n in (0, 37, 999)]

    def stored(ids):
        ends = token_store.cuts(ids)
        assert ends[-1] == len(ids) and ends == sorted(set(ends))
        return {ids[a:b].tobytes() for a, b in zip([0, *ends], ends)}

    a, b, c = (stored(np.concatenate([h, passage])) for h in heads)
    assert len(a & b & c) > 0.8 * len(a)
    assert token_store.cuts(np.zeros(0)) == [] and token_store.cuts(np.zeros(10_000, dtype=int))[-1] == 10_000


def test_repeated_paragraphs(spark):
    rng = np.random.default_rng(5)
    fresh = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 10**9, n))
    shared = fresh(60)
    near = shared.replace(shared.split()[30], "changed")
    far = " ".join(w if i % 3 else "other" + w for i, w in enumerate(shared.split()))
    texts = [fresh(40) + "\n" + shared, shared.upper().replace("V", "v") + "\nshort line\nshort line", fresh(30) + "\n" + near, far, fresh(80), None, "", fresh(20) + "\n" + fresh(20)]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {(r.doc_id, r.paragraph): (r.kept, r.copies) for r in paragraphs.repeated(d).collect()}
    assert got == {(0, 1): (True, 3), (1, 0): (False, 3), (2, 1): (False, 3)}
    left = {r.doc_id: r.text for r in paragraphs.without_repeats(d).collect()}
    assert left[0] == texts[0] and left[1] == "short line\nshort line" and left[2] == texts[2].split("\n")[0]
    assert all(left[i] == texts[i] for i in (3, 4, 5, 6, 7))


def test_repeated_paragraphs_against_all_pairs(spark, docs):
    least = 16
    lines = [(i, k, words(lower(x))) for i, t in docs_text(docs).items() for k, x in enumerate((t or "").split("\n")) if len(words(x)) >= least]
    sets = [frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) for _, _, w in lines]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {p for h in holders.values() for p in combinations(h, 2)}:
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    size = Counter(map(find, range(len(lines))))
    want = {(lines[i][0], lines[i][1]): size[find(i)] for i in range(len(lines)) if size[find(i)] > 1}
    got = {(r.doc_id, r.paragraph): r.copies for r in paragraphs.repeated(docs, least).collect()}
    assert got == want


def test_a_band_in_blocks_loses_nothing(spark, monkeypatch):
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :]), "en", "s", 1) for i in range(60)]
    d = spark.createDataFrame(rows, SCHEMA)
    whole = {(r.doc_id, r.copies) for r in paragraphs.repeated(d).collect()}
    monkeypatch.setattr(paragraphs, "BLOCK", 7)
    assert {(r.doc_id, r.copies) for r in paragraphs.repeated(d).collect()} == whole


def test_passages_against_all_runs_of_51_words(spark, docs):
    """Every run of 51 words that stands in two places, among the documents and in texts with planted ones."""
    rng = random.Random(8)
    fresh = lambda n: [f"p{rng.randrange(10**9)}" for _ in range(n)]
    one, two, short = fresh(60), fresh(51), fresh(50)
    wrapped = "\n".join(" ".join(one[i : i + 9]) for i in range(0, 60, 9))
    extra = [" ".join(fresh(40) + one + fresh(70)), " ".join(fresh(5)) + "\n" + wrapped, " ".join(fresh(30) + two + fresh(3) + two), " ".join(one[5:57]).upper().replace("P", "p"),
             " ".join(fresh(9) + short), " ".join(short + fresh(9)), "x " * 90, " ".join(fresh(10) * 9)]
    rows = [(10**6 + i, t, "en", "s", 1) for i, t in enumerate(extra)]
    d = docs.dropDuplicates(["doc_id"]).union(spark.createDataFrame(rows, SCHEMA))
    places = {}
    for r in d.collect():
        w = words(lower(r.text or ""))
        for i in range(len(w) - 50):
            places.setdefault(tuple(w[i : i + 51]), []).append((r.doc_id, i))
    want = {p: p == min(v) for v in places.values() if len(v) > 1 for p in v}
    got = {}
    for r in passages.repeated(d).collect():
        for i in range(r.start, r.start + r.n_words - 50):
            assert (r.doc_id, i) not in got
            got[r.doc_id, i] = r.kept
    assert got == want and len(want) > 100


def test_words_said_over_and_over_stay_whole(spark):
    """Two words by turns in many texts: few stretches and passages a text, not one for each window; all windows as brute force has them."""
    rng = random.Random(3)
    fresh = lambda n: [f"r{rng.randrange(10**9)}" for _ in range(n)]
    three = fresh(3)
    texts = [" ".join(fresh(i % 7) + ["das", "und"][i % 2 :] + ["das", "und"] * (100 + i) + fresh(i % 5)) for i in range(30)] + [" ".join(three * 60), " ".join(three[1:] + three * 20 + fresh(60)), "y " * 200]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    places = {}
    for i, t in enumerate(texts):
        w = t.split()
        for k in range(len(w) - 50):
            places.setdefault(tuple(w[k : k + 51]), []).append((i, k))
    want = {p: (p == min(v), len(v)) for v in places.values() if len(v) > 1 for p in v}
    got, rows = {}, passages.repeated(d).collect()
    for r in rows:
        at = range(r.start, r.start + r.n_words - 50)
        assert r.copies == max(want[r.doc_id, i][1] for i in at)
        for i in at:
            assert (r.doc_id, i) not in got
            got[r.doc_id, i] = r.kept
    assert got == {p: v[0] for p, v in want.items()} and len(want) > 5000
    assert len(rows) <= 3 * len(texts)
    marked = [(i, t, np.unique(passages.hashes(passages.joined_hashes([t])[0], passages.GRAM)).view(np.int64).tolist()) for i, t in enumerate(texts)]
    batch = pa.RecordBatch.from_arrays([pa.array([m[0] for m in marked]), pa.array([m[0] for m in marked]), pa.array([m[1] for m in marked]), pa.array([m[2] for m in marked], pa.list_(pa.int64()))], names=["row", "doc_id", "text", "marks"])
    made = pa.Table.from_batches(passages._stretches(iter([batch])))
    assert pa.compute.sum(made.column("n")).as_py() >= len(want) and made.num_rows < len(want) / 10


def test_rows_alike_are_one_document(spark):
    """Two rows of one doc_id and text: one is kept, once; another document with the text loses it."""
    rng = random.Random(4)
    one, two = (" ".join(f"k{rng.randrange(10**9)}" for _ in range(60)) for _ in range(2))
    d = spark.createDataFrame([(1, one, "en", "s", 1), (1, one, "en", "s", 1), (None, two, "en", "s", 1), (None, two, "en", "s", 1), (7, "own words here\n" + one, "en", "s", 1)], SCHEMA)
    got = sorted(((r.doc_id or 0, r.kept, r.copies) for r in paragraphs.repeated(d).collect()))
    assert got == [(0, True, 2), (1, True, 3), (7, False, 3)]
    got = sorted(((r.doc_id or 0, r.n_words, r.kept, r.copies) for r in passages.repeated(d).collect()))
    assert got == [(0, 60, True, 2), (1, 60, True, 3), (7, 60, False, 3)]
    left = sorted((r.doc_id or 0, r.text) for r in paragraphs.without_repeats(d).collect())
    assert left == [(0, two), (1, one), (7, "own words here")]


def test_clashing_names_keep_their_values(spark, docs):
    """Columns named like an operator's own come back with their own values."""
    names = ("_row", "_k", "_gone", "_cut", "_less", "_own_id", "_group", "_b", "_s", "_own", "row", "of", "k", "size")
    d = docs.where("doc_id < 40")
    for c in names:
        d = d.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    for made in (near_copies.deduplicated(d), paragraphs.without_repeats(d), mixing.mixed_documents(d), sketches.with_next(d.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *names), ["doc_id", "text"])):
        rows = made.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names)


def test_a_cluster_needs_the_shared_folder(spark):
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        common.shared_dir(Cluster)


def test_a_passage_goes_whatever_surrounds_it(spark):
    rng = random.Random(9)
    fresh = lambda n: [f"g{rng.randrange(10**9)}" for _ in range(n)]
    one, a, b, c = fresh(60), fresh(80), fresh(120), fresh(4)
    texts = [" ".join(a + one + b), " ".join(b[::-1] + one + a[::-1]), "\n".join([" ".join(c)] + [" ".join(one[i : i + 12]) for i in range(0, 60, 12)] + ["end  of it"])]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    left = {r.doc_id: r.text for r in paragraphs.without_repeats(d).collect()}
    assert left == {0: texts[0], 1: " ".join(b[::-1] + a[::-1]), 2: " ".join(c) + "\nend  of it"}


def test_quality_on_held_out_labels(spark):
    rows = registry.op5_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    held = rows.where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in held)


def test_sketches(spark):
    rng = np.random.default_rng(2)
    a = " ".join(f"t{x}" for x in rng.integers(0, 10**9, 3000))
    b = " ".join(a.split()[:1500] + [f"u{x}" for x in rng.integers(0, 10**9, 1500)])
    d = spark.createDataFrame([(a, b, a.upper().replace("T", "t"), "one two", None)], "a string, b string, c string, d string, e string")
    s = {c: sketches.sketch(F.col(c)) for c in "abcde"}
    r = d.select(
        sketches.resemblance(s["a"], s["b"]).alias("ab"), sketches.resemblance(s["a"], s["c"]).alias("ac"), sketches.containment(s["a"], s["b"]).alias("in_b"),
        sketches.distinct_count(s["a"]).alias("n"), F.size(s["d"]).alias("d"), F.size(s["e"]).alias("e"), sketches.resemblance(s["e"], s["e"]).alias("ee"), sketches.resemblance(s["a"], s["e"]).alias("ae"),
        (sketches.merge(sketches.sketch(F.substring("a", 1, 9000)), s["a"]) == s["a"]).alias("m")).first()
    assert abs(r.ab - 1 / 3) < 0.13 and r.ac == 1 and abs(r.in_b - 0.5) < 0.2 and abs(r.n - 2996) < 900
    assert (r.d, r.e, r.ee, r.ae) == (1, 0, 1, 0)


def test_fingerprint_query(spark, docs):
    got = {r.doc_id: r for r in registry.op6_fingerprints(spark, SF).collect()}
    texts = docs_text(docs)
    ids = sorted(texts)
    sh = lambda t: {" ".join(w[i : i + 5]) for w in [words(lower(t))] for i in range(max(1, len(w) - 4)) if w}
    off = []
    for i, d in enumerate(ids):
        t, n = texts[d] or "", texts[ids[(i + 1) % len(ids)]] or ""
        cut = len(t) // 4
        e = t[: len(t) - cut] + n[:cut]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        x, y = sh(t), sh(e)
        off.append(abs(got[d].near_edited - (len(x & y) / len(x | y) if x | y else 1)))
    assert max(off) < 0.2 and np.mean(off) < 0.03


def test_next_row_with_ties_and_nulls(spark):
    rows = [(None, "n1"), (None, "n2"), (5, "a"), (5, "b"), (1, "c"), (9, "d"), (9, "d")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for each in (1, 3, 100):
        got = Counter((r.text, r.next.text) for r in sketches.with_next(d, ["doc_id", "text"], each).collect())
        assert got == Counter([("n1", "n2"), ("n2", "c"), ("c", "a"), ("a", "b"), ("b", "d"), ("d", "d"), ("d", "n1")])


GRANT = """Permission is hereby granted, free of charge, to any
person obtaining a copy of this software and associated
documentation files (the "Software"), to deal"""


def test_license_scan(spark, docs):
    """Against every block of every length by brute force, with notices across line breaks and look-alikes."""
    bsd = next(t for _, m, t in licenses.TEMPLATES if m == "redistributions binary")
    made = ["X under the MIT license, Under the mit licence. apache-license version 2;", "Released UNDER the nice MIT License", "cc by\nnc cc-by-nc", None, "", "this work is licensed under gnu general public license version 3",
            "Copyright someone\n\n" + GRANT, "# " + GRANT.replace("\n", "\n# "), "word " * 40 + "\n".join(bsd.split()) + " word" * 40, "Released under the Apache License", "Licensed under CC BY 4.0", "Licensed under CC BY-SA 4.0",
            "permission is " + "and " * 40 + "hereby granted free of charge to any person obtaining", "the mit " * 30]
    extra = [(9001 + i, t, "en", "s", 1) for i, t in enumerate(made)]
    got = {r.doc_id: r for r in licenses.scan(docs.union(spark.createDataFrame(extra, SCHEMA))).collect()}
    texts = docs_text(docs) | {r[0]: r[1] for r in extra}
    for d, t in texts.items():
        w = re.findall(licenses.WORD, lower(t))
        at, base = [], set()
        for label, p in licenses.PHRASES.items():
            q = p.split()
            here = [i for i in range(len(w)) if w[i : i + len(q)] == q]
            at += here
            base |= {label} if here else set()
        found, best = set(base), 1.0 if base else 0.0
        for label, must, notice in licenses.TEMPLATES:
            v = re.findall(licenses.WORD, notice.lower())
            for i in range(len(w)):
                block = set(w[i : i + math.ceil(1.25 * len(v))])
                share = len(block & set(v)) / len(set(v))
                if share >= licenses.CONTAINMENT and set(must.split()) <= block:
                    found.add(label)
                    best = max(best, share)
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert (r.base_labels, r.labels, round(r.score, 9)) == (",".join(sorted(base)), ",".join(sorted(found)), round(best, 9))
    assert [got[9001 + i].labels for i in (1, 5, 6, 7, 8, 9, 10, 11, 12)] == ["mit", "gpl-3", "mit", "mit", "bsd", "", "", "", ""]


def test_packing(spark, docs, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    for table in (docs, odd):
        rows = packing.packed_documents(table, path).collect()
        want = Counter()
        for d in table.collect():
            ids = np.array(plain.encode(d.text or "", add_special_tokens=False).ids + [2], dtype="<u4")
            at, p = 0, 0
            while at < len(ids):
                to = at + ((len(ids) - at) % 1024 or 1024)
                want[d.doc_id, p, at, to - at, zlib.crc32(ids[at:to].tobytes())] += 1
                at, p = to, p + 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        bins = {}
        for r in rows:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for b in bins.values():
            at = 0
            for o, n in sorted(b):
                assert o == at
                at += n
            assert at <= 1024
        assert len(bins) <= 1.03 * -(-sum(r.length for r in rows) // 1024) + 2


def test_sum_of_squares_is_the_rule():
    lengths = np.random.default_rng(4).integers(1, 65, 300)
    where, offset = packing.sum_of_squares(lengths, 64)
    gaps = {}
    for s, b, o in zip(lengths.tolist(), where.tolist(), offset.tolist()):
        count = Counter(gaps.values())
        growth = lambda g: (2 * (count[g - s] - count[g] + 1) if g > s else 1 - 2 * count[g], g)
        open_ = sorted({g for g in gaps.values() if g >= s}, key=growth)
        gap = open_[0] if open_ else 64
        assert gaps.get(b, 64) == gap and o == 64 - gap
        gaps[b] = gap - s
        if gaps[b] == 0:
            gaps[b] = -1
    assert packing.sum_of_squares(np.zeros(0, dtype=int))[0].size == 0


def brute_repeats(w, k=8):
    seen = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    covered = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
    return len(covered)


def test_repetition_rules(docs, odd):
    for table in (docs, odd):
        texts = {}
        for r in table.select("doc_id", "text").collect():
            texts.setdefault(r.doc_id, []).append(r.text)
        for r in repetition.verdicts(table).collect():
            t = next(x for x in texts[r.doc_id] if len(words(x)) == r.n_words) or ""
            w = words(t)
            seen, dup = set(), 0
            for line in t.split("\n"):
                if words(line):
                    dup += line in seen
                    seen.add(line)
            assert (r.word_chars, r.n_symbols, r.n_dup_lines) == (sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup)
            assert r.n_repeat_words == brute_repeats(w)
            assert r.base_failed == (len(w) < 20 or 100 * r.n_repeat_words > 30 * len(w)) and not (r.kept and r.base_failed)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(6)
    for n, kinds in ((1, 1), (2, 1), (50, 2), (200, 3), (64, 1), (300, 200)):
        x = rng.integers(0, kinds, n)
        order, lcp = repetition.adjacent_lcp(x)
        want = sorted(range(n), key=lambda i: x[i:].tolist())
        assert order.tolist() == want
        for k in range(1, n):
            a, b = x[want[k - 1] :], x[want[k] :]
            m = min(len(a), len(b))
            d = np.flatnonzero(a[:m] != b[:m])
            assert lcp[k] == (d[0] if len(d) else m)


def test_sharding(spark, docs, odd):
    copies = spark.createDataFrame([(50_000 + i, "hot copy " * 40, "en", "s", 1) for i in range(400)], SCHEMA)
    lost = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a copy without id").alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "long"))])
    same = spark.range(2_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("one id " * 9).alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "long"))])
    for table in (docs, docs.union(copies), odd, lost, same, docs.union(lost)):
        rows = sharding.shard(table).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
            (d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in table.select("doc_id", "text").collect())
        sizes = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
        largest = max(r.size for r in rows)
        assert max(sizes) - min(sizes) <= 2 * largest + 0.005 * sum(sizes)
        for s in range(8):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_running_totals(spark):
    rng = np.random.default_rng(8)
    rows = [(int(k), int(v)) for k, v in zip(rng.integers(-50, 50, 500), rng.integers(0, 9, 500))]
    got = prefix.in_order(spark.createDataFrame(rows, "k long, v long"), "k", "v", ["v"], rows=20).orderBy("ordinal").collect()
    at = 0
    for i, ((k, v), r) in enumerate(zip(sorted(rows), got)):
        assert (r.ordinal, r.k, r.v, r.start) == (i, k, v, at)
        at += v


def every(spark, table):
    yield mixing.schedule(table)
    yield mixing.mixed_documents(table)
    yield simhash.classes(table)
    yield near_copies.deduplicated(table)
    yield paragraphs.repeated(table)
    yield paragraphs.without_repeats(table)
    model = quality.learn(table, spark.createDataFrame([(1, 1), (2, 0), (3, None)], "doc_id long, quality int"))
    yield quality.scored(table, model)
    yield quality.accepted(table, model)
    yield licenses.scan(table)
    yield repetition.verdicts(table)
    yield sharding.shard(table)
    yield packing.packed_documents(table, public_tokenizers.path("byte_bpe_50k.json"))
    yield sketches.with_next(table.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["doc_id", "text"])


def test_odd_rows_are_whole(spark, odd):
    n = odd.count()
    counts = [d.count() for d in every(spark, odd)]
    assert [counts[i] for i in (0, 2, 6, 8, 9, 10, 12)] == [n] * 7


def test_empty_tables(spark, empty):
    assert [d.count() for d in every(spark, empty)] == [0] * 13


def test_pipeline_stages(spark):
    kept = common.documents(spark, SF)
    columns = kept.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.written(stage(spark, kept, SF), "test_stage")
        assert out.columns == columns and out.count() > 0, name
        kept = out
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r.length for r in packed) == sum(len(plain.encode(r.text, add_special_tokens=False).ids) + 1 for r in kept.collect())


def test_writes_leave_no_shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    kept = lambda: {f for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    before, setting = kept(), spark.conf.get(common.CLEANUP)
    rows = lambda: spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    rows().write.format("noop").mode("overwrite").save()
    assert kept() - before  # what an execution leaves otherwise
    before = kept()
    tables = [common.written(rows(), "test_shuffled"), common.settled(spark, "test_shuffled", rows)]
    for _ in range(50):  # they are deleted a little later
        if kept() <= before:
            break
        time.sleep(0.1)
    assert kept() <= before and spark.conf.get(common.CLEANUP) == setting
    assert [t.count() for t in tables] == [10, 10]


def test_settled_tables_leave_nothing_on_the_way(spark):
    left = []

    def build():
        left.append(common.table_path(spark, "on_the_way"))
        spark.range(5).write.parquet(left[0])
        return common.settled(spark, "inner", lambda: common.written(spark.read.parquet(left[0]), "deeper")).where("id > 1")

    assert sorted(r.id for r in common.settled(spark, "outer", build).collect()) == [2, 3, 4]
    there = spark._jvm.org.apache.hadoop.fs.Path(left[0])
    assert not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
    with pytest.raises(ZeroDivisionError):
        common.settled(spark, "failing", lambda: 1 / 0)
    assert not common._under_way
