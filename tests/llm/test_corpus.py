"""The operators against brute force, on small tables with odd rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import struct
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check_oracle import TABLES, canonical
from hazeline.llm import (
    chat, components, decontaminate, exact_dedup, jaccard, language, licenses, packing, passages, pii, queries, token_store,
)
from hazeline.session import shared_folder

DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, n string, `a.b` string"


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def plain_words(text):
    return [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").translate(LOWER).encode()) if w]


@pytest.fixture(scope="module")
def rows():
    """Ids and texts: invented prose with copies, near copies, shared passages and odd texts."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefgéß") for _ in range(rnd.randint(1, 8))) for _ in range(400)]
    prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    texts = [" ".join(prose(rnd.randint(1, 200))) for _ in range(60)]
    seed, passage = prose(150), prose(80)
    for _ in range(40):  # a large group of near copies
        copy = list(seed)
        for _ in range(rnd.randint(0, 6)):
            copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [" ".join(prose(70) + passage + prose(70)) for _ in range(12)]
    texts += [texts[0]] * 15 + [texts[70]] * 3
    texts += ["", None, " ", "one", "One", "a b c d", "A  b\tc d", "a b c d e", "!!! 123", "x" * 30000, "a\n\n b  c", " ".join(prose(9000))]
    texts += ["Released under the MIT License. all rights reserved, CC-BY cc by", "+1 (988) 555-2485 a.b@c.de 4111 1111 1111 1111 1.2.3.4"]
    texts[61] = texts[61].title()
    out = list(enumerate(texts))
    return out + [out[3], out[75]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, ["en", "de", None][i % 3], "s", 1, "x", "y", "z") for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def nobody(spark):
    """Rows of nulls."""
    return spark.createDataFrame([(None,) * 8, (None, "a b", None, None, None, None, None, None)], SCHEMA)


def collected(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", sorted(set(queries.ORACLES)))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.execute(queries.ORACLES[name]).df()
    got = canonical(got[list(want.columns)])
    assert got.equals(canonical(want))


def test_contamination(spark, docs, rows, monkeypatch):
    text = dict(rows)
    items = [(1, " ".join(words(text[61])[:20])), (2, "!"), (3, None), (None, text[0]), (4, "One"), (4, "One"), (5, " ".join(words(text[101])[75:95]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    held = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - 12)) if w and i is not None else ():
            held[tuple(w[j : j + 13])].add(str(i))
    want = collections.Counter()
    for i, t in rows:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in held}:
            for j in range(len(w) - n + 1):
                if found := held.get(tuple(w[j : j + n])):
                    hit.update(range(j, j + n))
                    ids |= found
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        want[i, len(w), len(hit), len(ids), sha, bool(hit) and 20 * len(hit) >= len(w)] += 1
    for part in (decontaminate.PART_CHARS, 60):  # one automaton, several
        monkeypatch.setattr(decontaminate, "PART_CHARS", part)
        got = decontaminate.contamination_report(docs, benchmark)
        assert collections.Counter(tuple(r)[:6] for r in got.collect()) == want
        for r in got.where("size(spans) > 0").collect():
            assert sum(len(words(text[r["doc_id"]][s["start"] : s["end"]])) for s in r["spans"]) == r["n_hit"]
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert kept.count() == sum(n for k, n in want.items() if not k[5])
    assert decontaminate.decontaminate(docs, benchmark.where("false")).count() == docs.count()


def test_packing(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    own.encode_special_tokens = True
    got = packing.pack(docs, queries.tokenizer("word_bpe_49k.json"), size=64).toPandas()
    for i, t in rows:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = got[got.doc_id == i].drop_duplicates("start").sort_values("start")
        assert pieces.length.sum() == len(ids) and set(pieces.doc_tokens) == {len(ids)}
        for p in pieces.itertuples():
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids[p.start : p.start + p.length]))
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert ordered.groupby("sequence_id").length.sum().max() <= 64
    assert sorted(set(got.sequence_id)) == list(range(got.sequence_id.max() + 1))
    assert packing.pack(empty, queries.tokenizer("word_bpe_49k.json")).count() == 0


def test_shortest_pack_first_places_everything():
    rnd = random.Random(2)
    for _ in range(30):
        counts = {rnd.randint(1, 50): rnd.randint(1, 500) for _ in range(rnd.randint(1, 30))}
        patterns = packing.shortest_pack_first(counts, 50)
        placed = collections.Counter()
        for pattern, n in patterns:
            assert sum(length * times for length, times in pattern) <= 50
            for length, times in pattern:
                placed[length] += times * n
        assert placed == counts


def test_token_store(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    path = shared_folder(spark, "ids")
    token_store.write_tokens(docs, path, queries.tokenizer("byte_bpe_50k.json"), shard_tokens=3000)
    got = sorted(tuple(r) for r in token_store.read_tokens(spark, path).collect())
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert got == sorted(want)
    nothing = shared_folder(spark, "ids")
    token_store.write_tokens(empty, nothing, queries.tokenizer("byte_bpe_50k.json"))
    assert token_store.read_tokens(spark, nothing).count() == 0


def test_codes_give_random_access():
    rnd = np.random.default_rng(1)
    for ids in (rnd.integers(0, 70_000, 5000), rnd.integers(0, 1 << 32, 700), np.zeros(1), np.array([255, 256, 65535, 65536])):
        image = token_store.Image(token_store.encode_levels(ids.astype(np.uint32)))
        assert [image.token(i) for i in range(0, len(ids), 7)] == ids[::7].tolist()
        for low, high in ((0, len(ids)), (len(ids) // 3, len(ids) // 2), (len(ids), len(ids))):
            assert image.tokens(low, high).tolist() == ids[low:high].tolist()


def test_licenses(docs, rows, empty):
    phrases = {tuple(k.split()): v for k, v in licenses.PHRASES.items()}
    got = collections.Counter(tuple(r)[:6] for r in licenses.scan_licenses(docs).collect())
    want = collections.Counter()
    for i, t in rows:
        w = words(t)
        at = [(j, v) for k, v in phrases.items() for j in range(len(w)) if tuple(w[j : j + len(k)]) == k]
        want[i, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({v for _, v in at}))] += 1
    assert got == want
    labels = {r["labels"] for r in licenses.scan_licenses(docs).where("n_base > 0").collect()}
    assert labels == {"cc-by,mit,reserved"}
    assert licenses.scan_licenses(empty).count() == 0


def test_license_spans_survive_small_changes(spark):
    notice = licenses.TEMPLATES["mit"].replace("free of charge", "wholly free of charge").replace("obtaining", "getting")
    docs = spark.createDataFrame([(1, "x y z " * 50 + notice + " end " * 50), (2, "permission is hereby granted free")], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(docs).collect()} == {1: "mit", 2: ""}


def test_repeated_licenses_keep_their_labels(spark):
    notices = {k: licenses.TEMPLATES[k] for k in ("mit-short", "cc-by-nc", "cc-by-sa", "apache-short")}
    changed = licenses.TEMPLATES["isc"].replace("this software", "all this software")
    texts = [f"{v}. " * n for v in notices.values() for n in (1, 2, 5)] + [f"{changed}. " * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(docs).collect()}
    for i, k in enumerate(notices):
        label = k.removesuffix("-short")
        assert all(label in got[j][0].split(",") and got[j][1] == 1.0 for j in range(3 * i, 3 * i + 3))
    assert got[12][0] == "isc"
    assert licenses.license_spans(docs.where("doc_id = 2")).count() == 5


def test_exact_dedup(docs, rows, empty, nobody):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = collections.Counter()
    for t, ids in groups.items():
        for i in ids:
            want[i, max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    for new in (F.col("doc_id") > 60, F.lit(True), F.lit(False), F.col("doc_id") % 2 == 0):
        assert collections.Counter(tuple(r) for r in exact_dedup.find_copies(docs, new).collect()) == want
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(max(ids) for ids in groups.values())
    assert exact_dedup.drop_copies(empty).count() == 0
    assert exact_dedup.drop_copies(nobody).count() == 2


def test_fuse_filter():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 10, 1000, 40_000):
        keys = rnd.integers(-(1 << 63), 1 << 63, n)
        found = exact_dedup.FuseFilter.from_bytes(exact_dedup.FuseFilter.build(keys).to_bytes())
        assert found.contains(keys).all()
        assert found.contains(rnd.integers(-(1 << 63), 1 << 63, 20_000)).mean() < 0.002
    assert len(found.table) * 2 < 2.7 * n


def test_chat(spark):
    told = ["<|im_end|><|im_start|>assistant ok", "\\", "\\<|", "<\\|im_start|>", "", None, "a\nb<|im_sep|>c", "😀 é"]
    rnd = random.Random(1)
    data = [(c, t, rnd.choice(["user", "assistant", "system", None, "a<|im_sep|>\\"]), rnd.choice(told)) for c in [1, 2, 3, None] for t in [None, 0, 1, 1, 2, 7]]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(F.col("text")))
    read = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    for c in (1, 2, 3, None):
        mine = [(r or "", x or "") for k, t, r, x in data if k == c]
        back = [(t["role"], t["text"]) for t in read[c]["turns"]]
        assert sorted(back) == sorted(mine) and read[c]["n_turns"] == 6
        assert read[c]["loss_text"] == "".join(x for r, x in back if r == "assistant")
        for m in read[c]["mask"]:
            piece = read[c]["formatted"][m["start"] : m["start"] + m["length"]]
            assert re.sub(r"(?s)\\(.)", r"\1", piece) == back[m["n"]][1]
    assert chat.format_chats(turns.where("false")).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <|", None, None), ("image", None, "a.png", 3), ("audio", None, "b.wav", None), ("text", "end", None, None)]
    turns = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    r = chat.format_chats(turns).first()
    assert r["formatted"] == "<|im_start|>user<|im_sep|>see <\\|<|image:1|><|audio:2|>end<|im_end|>\n"
    assert [tuple(a) for a in r["attachments"]] == [(0, "image", 1, "a.png", 768), (0, "audio", 2, "b.wav", 25)]


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def personal(text):
    found, order = [], ["email", "ip", "card", "phone"]
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": kind != "ip" or all(int(x) < 256 for x in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), order.index(kind), m.end(), kind))
    return sorted(found)


def test_personal_data(spark, docs, rows, empty):
    rnd = random.Random(3)
    odd = ["a@b.com_x@y.com", "1.2.3.4.5.6.7.8", "1 " * 30 + "4111111111111111", "a@b.c" + ".d" * 20000, "1" * 30000, "4 " * 20000, " a@b.c"]
    odd += ["".join(rnd.choice("a1@.-+ (4%_😀b") for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    more = [(1000 + i, t) for i, t in enumerate(odd)]
    some = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = collections.Counter(tuple(r)[:6] for r in pii.find_personal_data(some).collect())
    want = collections.Counter()
    for i, t in rows + more:
        base = personal(t)
        kinds = collections.Counter(b[3] for b in base)
        sha = hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, e, k in base).encode()).hexdigest()
        want[i, kinds["email"], kinds["ip"], kinds["card"], kinds["phone"], sha] += 1
    assert got == want
    assert pii.find_personal_data(empty).count() == 0


def test_classifier_adds_spans(spark):
    lines = [(i, f"x mail a{i}.b@mail.com call +1 (988) 555-24{i:02d} password=abc123xyz{i}") for i in range(30)]
    got = pii.find_personal_data(spark.createDataFrame(lines, "doc_id long, text string"))
    assert all(len(r["spans"].split(",")) == 3 and "other:" in r["spans"] for r in got.collect())


def shingles(text):
    w = plain_words(text)
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(rows):
    """component_id by brute force."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return collections.Counter((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def test_jaccard(docs, rows, empty, nobody, monkeypatch):
    want = linked(rows)
    assert collections.Counter(tuple(r) for r in jaccard.similar(docs).collect()) == want
    monkeypatch.setattr(jaccard, "FRAGMENT", 400)  # many fragments
    monkeypatch.setattr(jaccard, "PAIRS", 50)
    assert collections.Counter(tuple(r) for r in jaccard.similar(docs).collect()) == want
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _, c in want if i == c}
    assert jaccard.similar(empty).count() == 0
    assert {tuple(r) for r in jaccard.similar(nobody).collect()} == {(None, 0, None), (None, 1, None)}


def test_jaccard_near_the_threshold(spark):
    """Chains and near misses, where stars alone don't decide."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(rnd.randint(0, 3)):
            copy[rnd.randrange(60)] = f"n{i}{rnd.random()}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collections.Counter(tuple(r) for r in jaccard.similar(docs).collect()) == linked(rows)


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (7, 7)] + [(i, i + 1) for i in range(20, 60)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 6), 1), 8: 8, 9: 8, **dict.fromkeys(range(20, 61), 20)}


def test_passages(docs, rows, empty, nobody):
    text = {i: plain_words(t) for i, t in rows}
    seen = collections.defaultdict(set)
    for i, w in text.items():
        for j in range(len(w) - 50):
            seen[tuple(w[j : j + 51])].add(i)
    want = {i for ids in seen.values() if len(ids) > 1 for i in ids}
    got = passages.find_passages(docs).collect()
    assert want <= {r["doc_id"] for r in got}
    for r in got:
        mine = set(jaccard.shingle_sets([" ".join(x.decode() for x in text[r["doc_id"]][r["first_word"] : r["end_word"]]).encode()]).__next__())
        assert r["end_word"] <= len(text[r["doc_id"]]) and len(mine) >= 30
    covered = collections.defaultdict(set)
    for r in got:
        covered[r["doc_id"]].update(range(r["first_word"], r["end_word"]))
    assert all(set(range(70, 150)) <= covered[i] for i in range(100, 112))  # the shared passage
    assert not {i for i in range(60) if i not in want} & set(covered)
    assert passages.find_passages(empty).count() == 0 and passages.find_passages(nobody).count() == 0


def test_exact_passages_need_no_leader(spark):
    """Copies are found also where the document of the smallest id is like both, but not near enough."""
    rnd = random.Random(11)
    found, want = set(), set()
    rows = []
    for k in range(30):
        passage = [f"p{k}x{i}" for i in range(60)]
        other = list(passage)
        other[20], other[40] = f"q{k}", f"r{k}"
        rows += [(3 * k, other), (3 * k + 1, passage), (3 * k + 2, passage)]
        want |= {3 * k + 1, 3 * k + 2}
    around = lambda: [f"a{rnd.random()}" for _ in range(30)]
    docs = spark.createDataFrame([(i, " ".join(around() + w + around())) for i, w in rows], "doc_id long, text string")
    for r in passages.find_passages(docs).collect():
        assert (r["first_word"], r["end_word"]) == (30, 90) and r["partner_id"] in want - {r["doc_id"]}
        found.add(r["doc_id"])
    assert found == want


@pytest.mark.parametrize("far", [True, False])
def test_near_passages_beside_far_leaders(spark, far):
    """Recall of planted near passages, held against brute force, with and without smaller documents like both."""
    rnd = random.Random(5)
    rows, pairs = [], []
    for k in range(100):
        passage = [f"p{k}x{i}" for i in range(60)]
        other, leader = list(passage), list(passage)
        other[rnd.randrange(22, 38)] = f"o{k}"
        leader[20], leader[40] = f"q{k}", f"r{k}"
        rows += [(3 * k, leader)] * far + [(3 * k + 1, passage), (3 * k + 2, other)]
        pairs.append((3 * k + 1, 3 * k + 2))
    around = lambda: [f"a{rnd.random()}" for _ in range(30)]
    texts = {i: around() + w + around() for i, w in rows}
    tokens = {i: [tuple(w[j : j + 5]) for j in range(len(w) - 4)] for i, w in texts.items()}

    def near(a, b):
        return any(len(set(tokens[a][j : j + 46]) & set(tokens[b])) >= 40 for j in range(len(tokens[a]) - 45))

    want = [p for p in pairs if near(*p)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    found = {r["doc_id"] for r in passages.find_passages(docs).collect()}
    assert len(want) > 80 and sum(a in found and b in found for a, b in want) >= 0.9 * len(want)
    assert all(any(near(i, j) for j in range(i - i % 3, i - i % 3 + 3) if j != i and j in texts) for i in found)


def test_common_lines_end(spark):
    """Texts that share two lines, none long enough, end without a passage; equal ones among them are found."""
    rnd = random.Random(6)
    one, two = [f"x{i}" for i in range(24)], [f"y{i}" for i in range(24)]
    unique = lambda n: [f"u{rnd.random()}" for _ in range(n)]
    texts = [unique(20) + one + unique(6) + two + unique(20) for _ in range(60)]
    texts += [one + two[:12] + one[:12] + two, one + two[:12] + one[:12] + two]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"] for r in passages.find_passages(docs).collect()} == {60, 61}


def test_long_texts_come_in_pieces(monkeypatch):
    """Windows of a text in pieces are those of the whole text."""
    tokens = np.random.default_rng(1).integers(0, 50, 400).astype(np.uint64)
    n = np.array([0, 300, 0, 55])

    def spans():
        out = set()
        for text, first, size in passages._blocks(n):
            for t, f, c in zip(text.tolist(), first.tolist(), size.tolist(), strict=True):
                centre, a, b = passages.compact_windows(tokens[f : f + c + 45], np.arange(c), 0)
                for x, low, high in zip((centre + f).tolist(), (a + f).tolist(), (b + f).tolist(), strict=True):
                    out |= {(t, s, x) for s in range(low, high + 1)}
        return out

    whole = spans()
    monkeypatch.setattr(passages, "BLOCK", 64)
    assert spans() == whole and len(whole) == 355


def test_sliding_minimum():
    values = np.random.default_rng(0).integers(0, 1000, 300).astype(np.uint64)
    for width in (1, 2, 3, 46, 64, 300):
        assert passages.sliding_minimum(values, width).tolist() == [values[i : i + width].min() for i in range(301 - width)]


def test_cross_parsing_matches_brute_force():
    rnd = random.Random(4)
    for _ in range(20):
        sample = bytes(rnd.choice([0, 1, 2, 3]) for _ in range(200))
        text = bytes(rnd.choice([0, 1, 2, 3, 9]) for _ in range(rnd.randint(1, 3 * language.BLOCK)))
        model = language.Model(["x"], [language.table(sample)], np.array([1.0]))
        want = 0
        for at in range(0, len(text), language.BLOCK):
            block, i = text[at : at + language.BLOCK], 0
            while i < len(block):
                n = 1
                while i + n < len(block) and block[i : i + n + 1] in sample:
                    n += 1
                want, i = want + 1, i + n
        assert model.phrases([text, b"", text])[0].tolist() == [want, 0, want]


def test_language(spark, docs, rows, empty):
    data = spark.read.parquet(f"{DATA}/documents.parquet")
    found = language.predictions(data).join(data.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(found) > 20 and (found.lang == found.lang_pred).mean() > 0.95
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(found.doc_id, found.held_out, strict=True))
    got = {r["doc_id"]: r for r in language.predictions(docs).collect()}
    for i, t in rows:
        known = any(c.isalpha() for c in t or "")
        assert (got[i]["lang_pred"] in ("de", "en")) == known and (got[i]["lang_pred"] == "und") == (not known)
        assert 0 <= got[i]["score"] <= 1
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == sum(any(c.isalpha() for c in t or "") for _, t in rows)
    assert language.predictions(empty).count() == 0
    assert {r["lang_pred"] for r in language.predictions(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_learns_from_long_texts(spark, docs, rows):
    long = {"aa": "abba cab " * 1000, "bb": "xyz zyx " * 1000}
    data = [(i, long[lang], lang) for i, lang in enumerate(["aa", "bb"] * 8)]
    data = spark.createDataFrame(data, "doc_id long, text string, lang string")
    assert all(r["lang_pred"] == ["aa", "bb"][r["doc_id"] % 2] for r in language.predictions(data).collect())
    kept = language.keep_identified(docs.withColumn("lang", F.lit(None).cast("string")))
    assert kept.count() == sum(any(c.isalpha() for c in t or "") for _, t in rows)


def test_encoder_matches_the_library():
    from tokenizers import Tokenizer

    from hazeline.llm.encoding import Encoder

    rnd = random.Random(1)
    odd = ["", " ", "  a", "a \nb", "\n\na b", "it's 's don't ''s", "<|endoftext|> a<|endoftext|>", "é ́a", "ΑΣ ΟΔΟΣ.", "\x1c a \x1cb", "a  b", "中文 字 123 4.5", "a ", "A.\nB.\nC"]
    odd += ["".join(rnd.choice("aB'sé \n\t.!_1 \x1ćΣ<|>") for _ in range(rnd.randint(0, 40))) for _ in range(4000)]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        own = Tokenizer.from_file(queries.tokenizer(name))
        own.encode_special_tokens = True
        for got, want in zip(Encoder(queries.tokenizer(name), spaced).encode_all(odd), own.encode_batch(odd, add_special_tokens=False), strict=True):
            assert got == struct.pack(f"<{len(want.ids)}I", *want.ids)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    known = [(i, t) for i, t in zip(docs.doc_id, docs.text, strict=True) if any(c.isalpha() for c in t or "")]
    last = {}
    for i, t in known:
        last[t] = max(i, last.get(t, i))
    once = sorted((i, t) for t, i in last.items())
    first = {i for i, _, c in linked(once) if i == c}
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    kept = spark.createDataFrame([(i, t) for i, t in once if i in first], "doc_id long, text string")
    clean = {r["doc_id"] for r in decontaminate.contamination_report(kept, benchmark).where("not contaminated").collect()}
    got = corpus_pipeline.run(spark, DATA).toPandas()
    assert set(got.doc_id) == clean and got.groupby("sequence_id").length.sum().max() <= 2048
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_the_rest_does_not_need_this_package():
    root = Path(corpus_pipeline.__file__).parent
    outside = [p for p in root.glob("hazeline/**/*.py") if "llm" not in p.parts]
    assert not [p for p in outside if "hazeline.llm" in p.read_text()]
