"""Each method against brute force, round trips or held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import textwrap
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm import decontaminate, hilbert_shards, language_id, license_scan, minhash_dedup, packing, quality_model, quality_rules, token_files, toxicity
from barloom.llm.common import held_out
from barloom.llm.components import connected_components
from barloom.llm.labelled import labelled_sample
from barloom.llm.tokens import piece_ids
from tests.conftest import SMALL

from .helpers import SCHEMA


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA)


def variants(n: int, seed: int, words: int = 80, edits: int = 9) -> list[str]:
    """Copies of one text with random words replaced: many pairs lie about the threshold."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(draw.randrange(edits)):
            own[draw.randrange(words)] = f"e{draw.randrange(10_000)}"
        out.append(" ".join(own))
    return out


def brute_components(texts: list[str], width: int) -> list[int]:
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize("width", [4, 5])
def test_dedup_finds_all_components(spark, width):
    texts = [t for k in range(5) for t in variants(24, k)] + ["a b c", "A b c", "", "x"]
    found = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(frame(spark, texts), width).collect()}
    assert [found[i] for i in range(len(texts))] == brute_components(texts, width)


def test_dedup_lays_large_buckets_out_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 7)
    monkeypatch.setattr(minhash_dedup, "PARTS", 3)
    texts = variants(60, 11, edits=14)
    found = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(frame(spark, texts), 4).collect()}
    assert [found[i] for i in range(len(texts))] == brute_components(texts, 4)


def test_posterior_limits_are_the_smallest_kept():
    limits = minhash_dedup.prune_limits(80)
    assert limits == sorted(limits) and limits[128] < 0.8 * 128
    same = np.zeros((1, 128), np.uint8)
    assert minhash_dedup.bayes_keep(same, same, limits).tolist() == [0]
    assert minhash_dedup.bayes_keep(same, same + 1, limits).tolist() == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in range(100, 130)} == {100}


def test_quality_rules(spark):
    prose = "This is a good sentence with enough words in it to count as prose. Another one follows it right here, and it is fine."
    menu = "home | news | sports | about | contact\nlogin | register | help | map | jobs"
    texts = [prose, prose + "\n" + menu, menu * 4, "short text.", (prose + "\n") * 3, "We use cookies on this site.\n" + prose, "a b c d e f g h i j k l m n o p q r s t"]
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(frame(spark, texts)).collect()}
    assert [rows[i]["kept"] for i in range(7)] == [True, True, False, False, False, True, False]
    assert rows[0]["clean_text"] == prose and rows[1]["clean_text"] == prose and rows[5]["clean_text"] == prose
    assert rows[4]["n_dup_lines"] == 2 and rows[4]["n_repeat_words"] == rows[4]["n_words"]
    assert rows[1]["n_symbols"] == 8


def test_repeated_words_by_brute_force(spark):
    draw = random.Random(3)
    texts = [" ".join(draw.choice("ab") for _ in range(draw.randrange(60))) for _ in range(40)]
    rows = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.quality_rules(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w, seen = t.split(), defaultdict(list)
        for k in range(len(w) - 7):
            seen[tuple(w[k : k + 8])].append(k)
        assert rows[i] == len({k + j for p in seen.values() if len(p) > 1 for k in p for j in range(8)})


def test_toxicity_folds_and_excuses():
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " trash ": 3.0, " lowe": 2.0})
    machine = toxicity.automaton(lexicon.patterns())
    hits = lambda t: lexicon.hits(toxicity.fold([t])[0], machine)[1]
    assert [hits(t) for t in ("an idiot.", "1D10T!", "іdіоt", "i​diot", "ｉｄｉｏｔ", "idiots", "the trash can", "trash, can", "loweiung", "slowe", "2020", "")] == [1, 1, 1, 1, 1, 0, 0, 0, 1, 0, 0, 0]
    many = ["x idiot y", "clean", "", "4 idiot"]
    assert [t.strip() for t in toxicity.fold(many)] == ["x idiot y", "clean", "", "idiot"]


def test_toxicity_learns(spark):
    draw = random.Random(5)
    texts, toxic = [], []
    for i in range(600):
        words = [f"plain{draw.randrange(400)}" for _ in range(30)]
        if i % 4 == 0:
            words[draw.randrange(30)] = "gruntel" + draw.choice("abcdef")
            words[draw.randrange(30)] = "gruntel" + draw.choice("abcdef")
        texts.append(" ".join(words))
        toxic.append(int(i % 4 == 0))
    docs = frame(spark, texts)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    out = held_out(F.col("doc_id"), 5, 0)
    rows = toxicity.score_toxicity(docs, toxicity.fit(docs, labels, out)).withColumn("out", out).collect()
    assert all((r["score"] >= 0.5) == bool(toxic[r["doc_id"]]) for r in rows) and any(r["out"] for r in rows)


def test_toxicity_by_brute_force(spark):
    """Every entry looked for at every place of the folded text, without an automaton."""
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    lexicon = toxicity.fit(docs, labels, held_out(F.col("doc_id"), 5, 0))
    lexicon.entries |= {" the": 0.5, " the ": 0.25, " an ": 0.125}
    lexicon.exceptions.append(" of the ")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, lexicon).collect()}
    hits = 0
    for r in docs.collect():
        text = toxicity.fold([r["text"] or ""])[0]
        starts = [i for i, c in enumerate(text) if c == " "]
        excused = [(i, i + len(p)) for p in lexicon.exceptions for i in starts if text.startswith(p, i)]
        total = n = 0
        for i in starts:
            own = [e for e in lexicon.entries if text.startswith(e, i)]
            if own and not any(a <= i < b - 1 for a, b in excused):
                total, n = total + lexicon.entries[max(own, key=len)], n + 1
        a, b, c = lexicon.scale
        x, y = np.log1p(max(0, total)), np.log1p(100 * max(0, total) / (len(text.split()) + 20))
        assert (got[r["doc_id"]]["n_hits"], got[r["doc_id"]]["n_terms"]) == (n, len(text.split()))
        assert np.isclose(got[r["doc_id"]]["score"], 1 / (1 + np.exp(-np.clip(a + b * x + c * y, -30, 30))))
        hits += n
    assert hits


def test_labelled_sample_is_the_same_in_any_order(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.withColumn("doc_id", F.col("doc_id") + 10_000))
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    labels = labels.union(labels.selectExpr("doc_id + 10000", "quality", "1 - toxic"))
    pick = lambda d, n: {tuple(r) for r in labelled_sample(d.repartition(n), labels.repartition(n), "toxic", F.lit(False), {0: 60, 1: 20}).select("doc_id", "text", "toxic").collect()}
    first = pick(docs, 3)
    assert first == pick(docs, 7) and 0 < len(first) <= 80 and len({t for _, t, _ in first}) == len(first)


def test_machine_equals_all_pairs():
    draw = np.random.default_rng(1)
    m = quality_model.Machine(np.zeros((1, 1)), 0.3, draw.normal(size=50), draw.normal(size=(50, 8)))
    at, x = np.array([3, 7, 20, 41]), draw.normal(size=4)
    pairs = sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert np.isclose(m.margin(at, x), 0.3 + m.linear[at] @ x + pairs)


@pytest.mark.parametrize("name", ["toxic", "quality"])
def test_held_out_accuracy(spark, name):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = held_out(F.col("doc_id"), 5, 0)
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, labels, out)) if name == "toxic" else quality_model.score_quality(docs, quality_model.fit(docs, labels, out))
    rows = scored.join(labels, "doc_id").where(out).select("score", name).where(f"{name} is not null").collect()
    good, bad = ([r["score"] for r in rows if r[name] == v] for v in (1, 0))
    assert sum(g > b for g in good for b in bad) + 0.5 * sum(g == b for g in good for b in bad) >= 0.8 * len(good) * len(bad)


def test_license_scan_matches_every_template(spark):
    words = re.compile(rb"[a-z0-9\x80-\xff]+")
    draw = random.Random(2)
    texts = []
    for _, template in license_scan.TEMPLATES:
        own = template.split()
        for drop in (0, 1, 2, 4, 8):
            kept = [w for i, w in enumerate(own) if i not in draw.sample(range(len(own)), min(drop, len(own) - 1))]
            texts.append("Intro line.\n" + " ".join(kept) + " and more words here\nend")
    rows = {r["doc_id"]: r for r in license_scan.license_scan(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        own, want = words.findall(t.lower().encode()), set()
        for (label, template), (_, text) in zip(license_scan.template_sets(), license_scan.TEMPLATES, strict=True):
            need = len(template) if len(template) <= 8 else -(-80 * len(template) // 100)
            for start in range(len(own)):
                run = own[start : start + -(-100 * len(words.findall(text.lower().encode())) // 80)]
                turn = next((k for k, w in enumerate(run) if w in license_scan.TURNS - template), len(run))
                if len(template & set(run[:turn])) >= need and template & license_scan.NAMES <= set(run[:turn]):
                    want.add(label)
        assert {x for x in rows[i]["labels"].split(",") if x.startswith("spdx:")} == want


def test_license_scan_reads_wrapped_headers_and_tells_licenses_apart(spark):
    wrap = lambda text, sign: "\n".join(sign + line for line in textwrap.wrap(text, 70))
    texts, want = [], []
    for label, template in license_scan.TEMPLATES:
        for sign in ("", "# ", " * "):
            texts.append(wrap("Copyright 2020 by the authors, all of them. " + template + ". Here the other text goes on.", sign))
            want.append(label)
    near = " ".join(f"x{i}" for i in range(40))
    texts += ["Licensed under CC BY 4.0.", "Released under the Apache License.", f"released {near} under {near} the {near} mit {near} license", "This work is licensed under the GNU General Public License, version 2", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"]
    rows = {r["doc_id"]: r for r in license_scan.license_scan(frame(spark, texts)).collect()}
    got = [",".join(x for x in rows[i]["labels"].split(",") if x.startswith("spdx:")) for i in range(len(texts))]
    assert got == want + [""] * 5 and all(rows[i]["score"] == 1.0 for i in range(len(want)))


@pytest.mark.parametrize("block", [8_000_000, 300])
def test_decontamination_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    draw = random.Random(9)
    vocabulary = [f"v{i}" for i in range(30)] + ["straße", "ÉTÉ"]
    items = {i: [draw.choice(vocabulary) for _ in range(draw.choice([3, 12, 25]))] for i in range(12)}
    texts = []
    for _ in range(30):
        t = [draw.choice(vocabulary) for _ in range(40)]
        if draw.random() < 0.6:
            own, at = items[draw.randrange(12)], draw.randrange(30)
            t[at:at] = own[: draw.choice([9, 10, 25])]
        texts.append("—, ".join(t).replace("v1—", "V1—"))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.decontaminate(frame(spark, texts), bench).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(low))
    for i, t in enumerate(texts):
        words, hit, found = split(t), set(), set()
        for item, own in items.items():
            own = split(" ".join(own))
            n = min(10, len(own))
            windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(str(item))
        r = rows[i]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(words), len(hit), len(found))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert sum(len(split(t[s["start"] : s["end"]])) for s in r["spans"]) == len(hit)


def test_hilbert_curve_is_a_walk_through_every_cell():
    points = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    order = points[np.argsort(hilbert_shards.hilbert_index(points, 3))]
    assert sorted(hilbert_shards.hilbert_index(points, 3)) == list(range(512))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_shards_hold_near_equal_bytes_and_whole_groups(spark):
    draw = random.Random(4)
    texts = ["x" * draw.randrange(200) + str(i) for i in range(3000)] + ["copied text"] * 50 + ["hot text " * 10] * 1500
    draw.shuffle(texts)
    rows = hilbert_shards.hilbert_shards(frame(spark, texts)).collect()
    size, slots, shards = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        shards[texts[r["doc_id"]]].add(r["shard"])
    assert sorted(size) == list(range(16)) and max(size.values()) - min(size.values()) < 0.05 * sum(size.values()) / 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for t, s in shards.items() if not t.startswith("hot"))


def test_shards_by_brute_force(spark):
    """Coordinates, curve, order and cuts written out for a small table."""
    draw = random.Random(6)
    rows = [(i, f"text {draw.randrange(150)} " + "y" * draw.randrange(30), draw.choice(["de", "en", None]), f"https://site{draw.randrange(9)}.example", draw.randrange(500)) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in hilbert_shards.hilbert_shards(docs, whole_percent=100).collect()}
    langs, sources = sorted({r[2] or "" for r in rows}), sorted({r[3] for r in rows})
    cuts = docs.agg(F.percentile_approx("n_chars", [i / 32 for i in range(1, 32)], 10_000)).first()[0]
    least = {}
    for r in rows:
        least[r[1]] = min(least.get(r[1], r), r)
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r[0])
    point = lambda t: [langs.index(least[t][2] or "") * 32 // len(langs), sources.index(least[t][3]) * 32 // len(sources), int(np.searchsorted(cuts, least[t][4], side="right"))]
    hashes = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64(F.col("text").cast("binary")).alias("h")).distinct().collect()}
    order = sorted(groups, key=lambda t: (int(hilbert_shards.hilbert_index(np.array([point(t)]))[0]), hashes[t]))
    total, at, slot = sum(len(r[1]) + 1 for r in rows), 0, defaultdict(int)
    for t in order:
        size = len(groups[t]) * (len(t) + 1)
        shard = min(15, (2 * at + size) * 16 // (2 * total))
        for i in sorted(groups[t]):
            assert (got[i]["shard"], got[i]["slot"], got[i]["group_cut"]) == (shard, slot[shard], False)
            slot[shard] += 1
        at += size


def test_shard_files_prune_in_every_dimension(spark, tmp_path):
    """Shards whose ranges of a dimension meet a query, against shards of rows in the order of their ids."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["doc_id"])
    placed = hilbert_shards.hilbert_shards(docs)
    hilbert_shards.write_shards(docs, placed, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert {tuple(r) for r in back.select("doc_id", "text", "shard").collect()} == {tuple(r) for r in docs.join(placed, "doc_id").select("doc_id", "text", "shard").collect()}
    plain = docs.withColumn("shard", (F.percent_rank().over(Window.orderBy("doc_id")) * 15.99).cast("int"))

    def read(rows, column):
        boxes = rows.groupBy("shard").agg(F.min(column).alias("low"), F.max(column).alias("high")).collect()
        values = [r[0] for r in docs.select(column).collect()]
        return sum(b["low"] <= v <= b["high"] for v in values for b in boxes) / len(values)

    for column in ("lang", "source", "n_chars"):
        assert read(back, column) < 0.8 * read(plain, column), column


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_piece_ids_equal_whole_texts(spark, name, spaces):
    table = piece_ids(public_tokenizers.path(name), spaces)
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    texts += ["it's we'll I'M don''t  foo.bar a\n\nb  \n c\t d", " x", "é'S café. café́. İstanbul ΣΑΣ. ΑΣ, 12a3 b4. a,b", "...", "  ", "a\x1cb c", "naïve—dash “q” ", "x<|endoftext|>y", "日本語。テスト", "ªº×÷ ß. ẞ. ŒUVRE", "", None]
    for text, ids in zip(texts, table.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == table.library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_added_tokens_equal_a_fresh_tokenizer(name, spaces):
    fresh = Tokenizer.from_file(public_tokenizers.path(name))
    texts = ["one <|endoftext|> two", "<|startoftext|>one", "a<|endoftext|><|endoftext|>b\n<|EndOfText|>", "<|endoftext|>", "<|endoftext", "plain text, twice."]
    for text, ids in zip(texts, piece_ids(public_tokenizers.path(name), spaces).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids
    assert len(fresh.encode(texts[0], add_special_tokens=False).ids) < 5


def test_token_files_count_added_tokens(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts, fresh = ["one <|endoftext|> two", "three"], Tokenizer.from_file(path)
    rows = token_files.read_token_files(token_files.write_token_files(frame(spark, texts), f"file://{tmp_path}", path)).orderBy("doc_id").collect()
    want = [np.array([*fresh.encode(t, add_special_tokens=False).ids, 1], "<u4") for t in texts]
    assert [(r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows] == [(s, len(x), zlib.crc32(x.tobytes())) for s, x in zip((0, len(want[0])), want, strict=True)]


def test_token_files_round_trip(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    manifest = token_files.write_token_files(docs, f"file://{tmp_path}", path)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(manifest).collect()}
    library, start = piece_ids(path, False).library, 0
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        assert got[r["doc_id"]] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    first = sorted(manifest.collect())[0]
    reader = token_files.open_sequences(first["file"])
    stream = np.concatenate([np.frombuffer(x, "<u4") for _, x in token_files.read_documents(first["file"])])
    for i in range(-(-len(stream) // token_files.SEQUENCE)):
        ids, mask = token_files.sequence_at(reader, i)
        assert ids[: mask.true_count].tolist() == stream[i * token_files.SEQUENCE : (i + 1) * token_files.SEQUENCE].tolist()
        assert not ids.flags.owndata


def test_table_of_pieces_changes_no_ids():
    """A worker that remembers more encodes less, and gives the same ids."""
    path, texts, made = public_tokenizers.path("byte_bpe_50k.json"), [f"one two w{chr(97 + i % 9)}x three" for i in range(30)], []
    for most in (500, 1_000_000):
        table = piece_ids(path, True, most=most)
        made.append(list(table.encode(texts)))
        assert (len(table) > 10) == (most > 500)
    assert made[0] == made[1]


def test_packing_holds_every_piece_once(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    table, sequences = piece_ids(public_tokenizers.path("byte_bpe_50k.json"), True), defaultdict(list)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d in docs.collect():
        data = next(table.encode([d["text"]])) + np.array([2], "<u4").tobytes()
        at = 0
        for k, r in enumerate(sorted(by_doc[d["doc_id"]], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(data[4 * at : 4 * (at + r["length"])]) and (k == 0 or r["length"] == 1024)
            at += r["length"]
        assert at == len(data) // 4
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.03 * sum(r["length"] for r in rows) / 1024 + 2


def test_sum_of_squares_takes_the_smallest_change():
    draw = random.Random(8)
    lengths = [draw.randrange(1, 21) for _ in range(300)]
    bins, offsets = packing.sum_of_squares(np.array(lengths), 20)
    room: list[int] = []
    for s, b, o in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):
        def cost(rooms):
            return sum(rooms.count(g) ** 2 for g in set(rooms) - {0})

        options = [cost(room[:i] + [g - s] + room[i + 1 :]) for i, g in enumerate(room) if g >= s] + [cost([*room, 20 - s])]
        if b == len(room):
            room.append(20)
        assert 20 - room[b] == o
        room[b] -= s
        assert cost(room) == min(options)


def test_language_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs, held_out(F.col("doc_id"), 4, 2)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("size", [1_000_000, 64])
def test_grams_of_long_and_joined_texts_agree(monkeypatch, size):
    text = "Ein Wort, noch eins! " * 300
    clean = " ein wort noch eins" * 300 + " "
    whole = [len(clean) - n + 1 for n in language_id.ORDERS]
    count = lambda found, who: [sum((owner == who).sum() for k, _, owner in found if k == order) for order in range(3)]
    counts = lambda found, who: np.stack([sum((np.bincount(b[o == who], minlength=language_id.BUCKETS) for k, b, o in found if k == order), np.zeros(language_id.BUCKETS, int)) for order in range(3)])
    alone = counts(list(language_id.grams([text])), 0)
    monkeypatch.setattr(language_id, "SLICE", size)
    joined = list(language_id.grams(["x y", text, ""]))
    assert count(joined, 1) == whole
    assert (counts(joined, 1) == alone).all()


def test_language_by_brute_force(spark):
    """Naive Bayes written out: a dictionary of n-gram counts for each language."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.collect()
    plain = lambda t: " " + " ".join("".join(c if c.isalpha() else " " for c in (t or "").lower()).split()) + " "
    grams = lambda t: [(n, t[i : i + n]) for n in language_id.ORDERS for i in range(len(t) - n + 1)]
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    counts, n_docs = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for r in rows:
        if not out(r["doc_id"]) and r["lang"] is not None and r["text"] is not None:
            n_docs[r["lang"]] += 1
            for g in grams(plain(r["text"])):
                counts[r["lang"]][g] += 1
    size = {(lang, n): sum(c for (m, _), c in found.items() if m == n) for lang, found in counts.items() for n in language_id.ORDERS}
    got = {r["doc_id"]: r for r in language_id.identify(docs, held_out(F.col("doc_id"), 4, 2)).collect()}
    same = 0
    for r in rows:
        own = grams(plain(r["text"]))
        joint = {lang: np.log(n_docs[lang] / sum(n_docs.values())) + sum(np.log((counts[lang].get(g, 0) + 0.5) / (size[lang, g[0]] + 0.5 * language_id.BUCKETS)) for g in own) / 3 for lang in n_docs}
        best = max(joint, key=joint.get)
        same += got[r["doc_id"]]["lang_pred"] == best and abs(got[r["doc_id"]]["score"] - 1 / sum(np.exp(v - joint[best]) for v in joint.values())) < 0.02
    assert same >= 0.99 * len(rows)  # hashing joins a few n-grams


def test_too_many_cells_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_CELLS", 3 * language_id.BUCKETS)
    docs = frame(spark, ["ein wort", "a word"]).withColumn("lang", F.col("source"))
    with pytest.raises(ValueError, match="fewer buckets"):
        language_id.fit(docs)
    assert language_id.fit(docs, buckets=1 << 12).logs.shape == (3 << 12, 2)
