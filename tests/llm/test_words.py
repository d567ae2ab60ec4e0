"""Spelling variants, SentencePiece ids and periodic runs against brute force and the library."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from assayline.llm import periodic, pieces, variants
from assayline.llm.suffixtree import Extensions

SCHEMA = "text string, word string, doc_id long, n long, ids string"


def odd_rows(spark, texts):
    """Texts with null, empty and repeated rows, a null id, and columns whose names the operators use themselves."""
    rows = [(t, "x", i, 7, None) for i, t in enumerate(texts)] + [(None, None, 900, None, "y"), ("", "", 901, 0, ""), (texts[0], "x", 0, 7, None), (texts[-1], "z", None, 1, None)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3), [(r[2], r[0] or "") for r in rows]


# Spelling variants


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_counts(rows, least_points=5, least_count=3):
    seen = Counter()
    for doc_id, text in rows:
        for w in map(lowered, re.findall("[A-Za-zÀ-ÿ]+", text)):
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if doc_id is not None and h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            seen[w] += 1
    return {w: n for w, n in seen.items() if len(w) >= least_points and n >= least_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_forms(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 2 * counts[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def spelt(seed):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("abé×th") for _ in range(rnd.randint(5, 9))) for _ in range(30)]

    def vary(w):
        k, c = rnd.randrange(len(w) + 1), rnd.choice("abézT")
        return rnd.choice([w, w, w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w[:k] + w[k + 1 :], w.upper()])

    return [" ".join(vary(vary(rnd.choice(stems[: rnd.randint(1, 30)]))) for _ in range(300)) + " 12a-b " for _ in range(12)] + ["y" * 40_000 + " " + "y" * 39_999] * 3


@pytest.mark.parametrize("bucket", [2, 2048])
def test_variants_equal_brute_force(spark, bucket):
    df, rows = odd_rows(spark, spelt(bucket))
    cfg = variants.VariantConfig(bucket=bucket, portion_bytes=4000)
    words = variants.word_counts(df, cfg, plant=True)
    want = plain_forms(plain_counts(rows))
    got = [tuple(r) for r in variants.variant_forms(words, cfg).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(want) and set(got) == want
    assert sum(r[1] is not None and r[2] != r[1] for r in want) > 0  # chains of forms
    assert variants.variant_forms(words.limit(0), cfg).count() == 0


def test_variant_pairs_come_once(spark):
    words = spark.createDataFrame([(w, 5) for w in ("aaaaa", "aaaaaa", "aaaaaaa", "baaaa", "aaaab", "aaaaaé")], "word string, n long")
    got = [(r.word, r.other) for r in variants.near_pairs(words).collect()]
    assert len(got) == len(set(got))
    names = [r.word for r in words.collect()]
    assert {frozenset(p) for p in got} == {frozenset((a, b)) for a in names for b in names if a < b and one_edit(a, b)}


def test_chain_of_forms_is_followed_to_its_end(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w5")], "word string, root string")
    got = {r.word: r.root for r in variants.root_of(links, variants.VariantConfig()).collect()}
    assert set(got.values()) == {"w37"} and len(got) == 38


# SentencePiece


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def strange(library, seed, n):
    rnd = random.Random(seed)
    known = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.get_piece_size())]
    kinds = [
        lambda: "".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0, 0xD7FF), rnd.randrange(0xE000, 0x110000)])) for _ in range(rnd.randint(0, 60))),
        lambda: "".join(rnd.choice(known) for _ in range(rnd.randint(0, 40))),
        lambda: "".join(rnd.choice(known).strip() for _ in range(3)) * rnd.randint(1, 30),
        lambda: "".join(rnd.choice(["a", " ", "  ", "▁", "\n", "the", " " * rnd.randint(1, 60)]) for _ in range(rnd.randint(0, 60))),
        lambda: "".join(rnd.choice("etaoinsrhl") for _ in range(rnd.randint(0, 400))),
    ]
    return [rnd.choice(kinds)() for _ in range(n)]


def test_pieces_equal_the_library(library):
    model = pieces.PieceModel(pieces.PieceConfig())
    long = ["a" * 50_000, " " * 50_000 + "x", "ab" * 20_000, "日本" * 9000, "=" * 30_000 + " " * 50]
    for texts in ([], [""], strange(library, 1, 400), strange(library, 2, 400), long):
        ids, counts = model.encode(texts)
        assert len(ids) == counts.sum()
        for t, got, back in zip(texts, np.split(ids, np.cumsum(counts)[:-1]) if texts else [], model.decode(ids, counts), strict=True):
            want = library.encode(t)
            assert got.tolist() == want, t[:80]
            assert back.decode() == library.decode(want)


def test_any_ids_decode_as_in_the_library(library):
    rnd = random.Random(4)
    model = pieces.PieceModel(pieces.PieceConfig())
    for _ in range(300):
        ids = [rnd.choice([rnd.randrange(3, 32000), rnd.randrange(3, 259)]) for _ in range(rnd.randint(1, 12))]
        [got] = model.decode(np.array(ids), np.array([len(ids)]))
        first = library.id_to_piece(ids[0])
        if not first.strip("▁"):
            continue  # a text of spaces alone comes from encode() in one way only
        assert got.decode() == library.decode(ids), ids


def test_piece_digests_of_odd_rows(spark, library):
    df, rows = odd_rows(spark, strange(library, 5, 60) + ["\x00 nul", "word " * 20_000])
    want = []
    for doc_id, text in rows:
        ids = library.encode(text)
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    cfg = pieces.PieceConfig(portion_bytes=500)
    assert Counter(map(tuple, pieces.piece_digests(df, cfg).collect())) == Counter(want)
    got = pieces.encoded(df, cfg).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == Counter((i, tuple(library.encode(t)), library.decode(library.encode(t))) for i, t in rows)
    assert pieces.piece_digests(df.limit(0)).count() == 0


# Periodic runs


def plain_runs(words, least=6, times=4):
    out = []
    for q in range(1, len(words) // times + 1):
        same = [words[k] == words[k + q] for k in range(len(words) - q)] + [False]
        start = None
        for k, s in enumerate(same):
            if s and start is None:
                start = k
            elif not s and start is not None:
                part = words[start : k + q]
                if len(part) >= max(least, times * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                    out.append((start, len(part), q))
                start = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{b},{c}\n" for a, b, c in runs), " ".join(w for k, w in enumerate(words) if k not in gone))]
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], *sha)


def echoing(rnd):
    k = rnd.choice([1, 2, 2, 3, 5])
    words = [rnd.choice("abcdé"[:k]) for _ in range(rnd.randint(0, 60))]
    for _ in range(rnd.randint(0, 3)):
        at = rnd.randint(0, len(words))
        words[at:at] = [rnd.choice("abcdé"[:k]) for _ in range(rnd.randint(1, 7))] * rnd.randint(2, 9)
    return words


def test_runs_equal_brute_force():
    rnd = random.Random(11)
    found = 0
    for _ in range(600):
        texts = [echoing(rnd) for _ in range(rnd.randint(1, 4))]
        for words, got in zip(texts, periodic.document_runs([[w.encode() for w in t] for t in texts]), strict=True):
            want = plain_runs(words)
            found += len(want)
            assert [tuple(r) for r in got.tolist()] == want, words
    assert found > 1000


def test_common_extensions():
    rnd = random.Random(12)
    for n in (1, 2, 40, 700):
        s = [rnd.randint(1, 2) for _ in range(n)] + [0]
        e = Extensions(s, 3)
        assert e.rank.tolist() == [sorted(range(n + 1), key=lambda i: s[i:]).index(i) for i in range(n + 1)] if n < 100 else True
        a, b = np.array([(i, j) for i in range(n + 1) for j in range(n + 1) if i != j][:20_000]).T
        want = [next(k for k in range(n + 1) if s[i + k] != s[j + k]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        assert e.common(a, b).tolist() == want


def test_runs_of_odd_rows(spark):
    rnd = random.Random(13)
    texts = [rnd.choice([" ", "\n", "\x0b \t"]).join(echoing(rnd)) for _ in range(80)] + ["a b " * 10_000, "a b\x1cc " * 9, "w"]
    df, rows = odd_rows(spark, texts)
    got = periodic.periodic_runs(df, periodic.RunConfig(portion_bytes=300), plant=True)
    assert Counter(map(tuple, got.collect())) == Counter(plain_row(*r) for r in rows if len(r[1]) < 10_000) + Counter(tuple(r) for r in got.where("doc_id = 80").collect())
    [long] = got.where("doc_id = 80").collect()
    assert long.n_runs >= 1 and long.exponent_milli >= 4000
    assert periodic.periodic_runs(df.limit(0), plant=True).count() == 0
    with pytest.raises(ValueError):
        periodic.RunConfig(times=3)
