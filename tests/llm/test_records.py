"""Mixing, tokens, media, archives and licences against independent versions, and on awkward rows."""

from __future__ import annotations

import hashlib
import pkgutil
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import slow_jpeg
from rankweave.llm import jpeg
from rankweave.llm.license_texts import BODIES, FULL_TEXTS, body_templates, sections
from rankweave.llm.licenses import TEMPLATES, StretchScanner, bigrams, license_scan, license_stretches, units
from rankweave.llm.mixing import systematic_mix, word_count
from rankweave.llm.scratch import Scratch
from rankweave.llm.textcore import find_words, gram_hashes, pieces, word_hashes
from rankweave.llm.warc import read_payloads, read_records, reconstruct, write_archive

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NASTY = ["", " ", "a", "\t\n\x0b\x0c\r", "é ü", "日本 語", "x" * 700, "a" * 256, "b" * 257, "\x1c\x1d a\x85b", "🙂 🙂"]


def test_words_and_hashes():
    rng = random.Random(0)
    texts = NASTY + ["".join(rng.choice("ab \n\té🙂") for _ in range(rng.randrange(40))) for _ in range(300)]
    for size in (1, 64, 1 << 20):
        seen: dict[bytes, set[int]] = defaultdict(set)
        out = []
        for piece in pieces(pa.array([*texts, None]), size):
            w = find_words(piece)
            h = word_hashes(piece.data, w.starts, w.ends)
            flat = [piece.data[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)]
            for x, y in zip(flat, h.tolist(), strict=True):
                seen[x].add(y)
            out += [flat[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        assert out == [[x.encode() for x in WORD.findall(t)] for t in texts] + [[]]
        assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 8, 35])
def test_gram_hashes_depend_on_all_entries_in_order(k):
    h = np.random.default_rng(k).integers(0, 2**63, 40).astype(np.uint64)
    h[20:] = h[:20]
    g = gram_hashes(h, k)
    assert len(g) == max(0, 41 - k)
    want = [tuple(h[i : i + k]) for i in range(len(g))]
    assert all((g[i] == g[j]) == (want[i] == want[j]) for i in range(len(g)) for j in range(len(g)))


# -- mixing -----------------------------------------------------------------------------------------


def brute_targets(sizes):
    """Exact water filling: sources in order, null last, weights 5, 2, 1."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, out = Fraction(3 * sum(sizes.values()), 2), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = Fraction(2 * sizes[s])
            left -= out[s]
        open_ -= full
    return out


@pytest.mark.parametrize("name", ["generated", "awkward", "skewed"])
def test_mix(request, spark, name):
    if name == "skewed":
        rng = random.Random(4)
        rows = [(k, "w " * rng.choice([1, 3, 3, 3, 50, 400]), rng.choice(["hot"] * 8 + ["Z", "a", "é", None])) for k in range(1500)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    else:
        docs = request.getfixturevalue(name)
    sized = docs.withColumn("_w", word_count(F.col("text")))
    rows = systematic_mix(sized, size_col="_w").collect()
    assert len(rows) == docs.count()
    sizes = Counter()
    for r in rows:
        assert r._w == len(WORD.findall(r.text or "")) and 0 <= r.copies <= 2
        sizes[r.source] += r._w
    want = brute_targets(sizes)
    taken, largest = Counter(), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]), rel=1e-9)
        taken[r.source] += r._w * r.copies
        largest[r.source] = max(largest[r.source], r._w)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * largest[s]
    again = Counter((r.doc_id, r.text, r.copies) for r in systematic_mix(sized.repartition(7), size_col="_w").collect())
    assert again == Counter((r.doc_id, r.text, r.copies) for r in rows)


def test_mix_of_nothing(none):
    assert systematic_mix(none.withColumn("_w", word_count(F.col("text"))), size_col="_w").count() == 0


# -- tokens -------------------------------------------------------------------------------------------


def test_tokens_equal_the_library(awkward, none, spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from rankweave.llm.bpe import ByteBpe, decode, encode, encode_digests

    path = public.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), ByteBpe(path)
    rng = random.Random(6)
    texts = ["", "<|endoftext|>", "a <|endoftext|> b", "don't  we'll\n\n x", "aaaaaaaaaaaa", "naïve 日本語 🙂🙂 x", *NASTY]
    texts += ["".join(rng.choice(" \n\tab'stlé日🙂  Ⅷ²x1!?<|") for _ in range(rng.randrange(60))) for _ in range(500)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x2FFF), rng.randint(32, 127), rng.randint(0x10000, 0x1FFFF)])) for _ in range(30)) for _ in range(300)]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = own.encode(t)
        assert ids == e.ids and own.decode(ids) == library.decode(e.ids, skip_special_tokens=False)
    assert own.decode([own.encode("日")[0]]) == "�"

    rows = encode_digests(awkward, path).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for r in awkward.collect():
        e = library.encode(r.text or "", add_special_tokens=False)
        want[(r.doc_id, len(e.ids), sha(",".join(map(str, e.ids))), sha(library.decode(e.ids, skip_special_tokens=False)))] += 1
    assert Counter(tuple(r) for r in rows) == want
    back = decode(encode(awkward, path), path)
    assert back.where(~F.coalesce("text", F.lit("")).eqNullSafe(F.col("decoded"))).count() == 0
    assert encode_digests(none, path).count() == 0


def test_small_tables_of_kept_chunks(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    from rankweave.llm import bpe

    texts = [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(30)]
    want = [x.tolist() for x in bpe.ByteBpe(public.path("byte_bpe_50k.json")).encode_texts(texts)]
    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 300)
    assert [x.tolist() for x in bpe.ByteBpe(public.path("byte_bpe_50k.json")).encode_texts(texts)] == want


# -- media ----------------------------------------------------------------------------------------------


def test_jpeg_round_trip_and_thumbnail():
    rng = random.Random(1)
    payloads = [jpeg.pad(b) for b in [b"", b"a", b"\0" * 500, bytes(range(256)) * 3, bytes([128]) * 70 + b"\0" * 40 + b"x", b"\xff" * 640, *(bytes(rng.choices(range(256), k=rng.randint(0, 5000))) for _ in range(30))]]
    payloads.append(b"x" + b"\0" * 80 + b"e" + b"\0" * 110)
    images = jpeg.write_images(payloads)
    for p, (head, blocks) in zip(payloads, jpeg.read_images(images), strict=True):
        assert jpeg.payload(head, blocks) == p
        thumb = jpeg.thumbnail(head, blocks)
        assert thumb.shape == (head.height // 8, head.width // 8)
        want = [int(np.clip((int(jpeg.TO_VALUE[b]) + 4 >> 3) + 128, 0, 255)) for b in p[::64]]
        assert thumb.reshape(-1).tolist() == want + [128] * (thumb.size - len(want))


def test_written_images_by_an_independent_decoder():
    rng = random.Random(7)
    payloads = [jpeg.pad(bytes(rng.choices(b"some letters \0\xff\xc3\xa4", k=n))) for n in (0, 1, 64, 65, 500, 64 * 16 + 1, 64 * 40)]
    for p, image in zip(payloads, jpeg.write_images(payloads), strict=True):
        width, height, blocks = slow_jpeg.decode_grey(image)
        flat = [v for block in blocks for v in block]
        assert (width // 8) * (height // 8) == len(blocks)
        assert flat[: len(p)] == [int(jpeg.TO_VALUE[b]) for b in p] and not any(flat[len(p) :])


def _colour(rng, width, height, factors):
    hmax, vmax = max(h for h, _ in factors), max(v for _, v in factors)
    down, across = -(-height // (8 * vmax)), -(-width // (8 * hmax))

    def block():
        out = [0] * 64
        out[0] = rng.randint(-500, 500)
        for _ in range(rng.choice([0, 1, 5, 63])):
            out[rng.randint(1, 63)] = rng.randint(-300, 300)
        return out

    return [{"h": h, "v": v, "blocks": [[block() for _ in range(across * h)] for _ in range(down * v)]} for h, v in factors]


def test_images_of_another_writer():
    """Colour, subsampling, single scans, any restart interval: luminance as an independent coder put it in."""
    rng = random.Random(11)
    images, want = [], []
    for factors in ([(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 1), (1, 1), (1, 1)], [(1, 2), (1, 1)], [(1, 1), (2, 2)], [(2, 2)]):
        for width, height in ((1, 1), (37, 21), (64, 40), (100, 9)):
            for interval in (0, 1, 3):
                for scans in {None, "single"} if len(factors) > 1 else {None}:
                    c = _colour(rng, width, height, factors)
                    order = [[k] for k in reversed(range(len(factors)))] if scans else None
                    images.append(slow_jpeg.encode(c, width, height, interval, order))
                    h, v = max(h for h, _ in factors), max(v for _, v in factors)
                    rows, columns = -(-(-(-height * factors[0][1] // v)) // 8), -(-(-(-width * factors[0][0] // h)) // 8)
                    want.append((width, height, [c[0]["blocks"][y][x] for y in range(rows) for x in range(columns)], (rows, columns)))
    for got, (width, height, blocks, shape) in zip(jpeg.read_images(images), want, strict=True):
        assert not isinstance(got, str), got
        head, mine = got
        assert (head.width, head.height) == (width, height) and mine.tolist() == blocks
        assert jpeg.payload(head, mine) is None
        # a sample of the thumbnail is the mean of its block: DC through the inverse transform, in eighths, plus 128
        means = [min(255, max(0, (b[0] + 4) // 8 + 128)) for b in blocks]
        assert jpeg.thumbnail(head, mine).shape == shape and jpeg.thumbnail(head, mine).reshape(-1).tolist() == means


def test_thumbnail_hash_by_definition():
    rng = np.random.default_rng(3)
    for shape in ((1, 1), (8, 8), (5, 31), (40, 16), (64, 64)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        h, w = shape
        bits = []
        for r in range(8):
            for c in range(8):
                y, x = r * h // 8, c * w // 8
                cell = image[y : max((r + 1) * h // 8, y + 1), x : max((c + 1) * w // 8, x + 1)].astype(int)
                bits.append(int(Fraction(int(cell.sum()), cell.size) > Fraction(int(image.astype(int).sum()), h * w)))
        assert jpeg.thumbnail_hash(image) == f"{int(''.join(map(str, bits)), 2):016x}"


def test_broken_images_are_told_apart(spark):
    good = jpeg.write_images([jpeg.pad(b"some text"), jpeg.pad(b"more " * 900)])
    progressive = good[0].replace(b"\xff\xc0", b"\xff\xc2")
    huge = good[0].replace(b"\x00\x08\x00\x08\x01", b"\xff\xff\xff\xff\x01")
    rng = random.Random(5)
    bad = [b"xx" + good[0][2:], good[1][: len(good[1]) // 3], good[1][: len(good[1]) // 3] + b"\xff\xd9", progressive, huge, b"\xff\xd8", good[0][:40]]
    for _ in range(200):  # no bytes may stop the reader
        x = bytearray(good[rng.randrange(2)])
        for _ in range(rng.randint(1, 20)):
            x[rng.randrange(len(x))] = rng.randrange(256)
        jpeg.read_images([good[0], bytes(x)])
        assert jpeg.payload(*jpeg.read_images([bytes(x), good[0]])[1]) == jpeg.pad(b"some text")
    assert all(isinstance(x, str) and x for x in jpeg.read_images(bad))
    rows = [(k, bytearray(x) if x is not None else None) for k, x in enumerate([*bad, good[1], None, b""])]
    got = {r.n: r for r in jpeg.read_media(spark.createDataFrame(rows, "n int, media binary"), keep=("n",)).collect()}
    for k, x in enumerate(bad):
        assert got[k].error and got[k].payload_sha256 is None and got[k].width is None and got[k].media_sha256 == hashlib.sha256(x).hexdigest()
    assert got[len(bad)].error is None and got[len(bad)].payload_bytes == len(jpeg.pad(b"more " * 900))
    assert all(got[len(bad) + k].media_sha256 is None and got[len(bad) + k].error is None for k in (1, 2))


def test_media_of_awkward_rows(awkward, none):
    rows = jpeg.read_media(jpeg.add_media(awkward), keep=("doc_id",)).collect()
    want = Counter()
    for r in awkward.collect():
        p = jpeg.pad((r.text or "").encode())
        want[(r.doc_id, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
    assert Counter((r.doc_id, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert len({(r.media_sha256, r.feature) for r in rows}) == len({r.payload_sha256 for r in rows})
    assert jpeg.read_media(jpeg.add_media(none), keep=("doc_id",)).count() == 0


# -- archives -------------------------------------------------------------------------------------------


def test_archive(spark):
    big, other = "é" * 600, "z" * 1000
    rows = [(1, "u1", big), (5, "u\r\nX: y", big), (3, None, big), (2, "u2", "small"), (4, "u4", "small"), (6, "u6", None), (7, "u7", ""), (8, "u8", other), (None, "n", other), (9, "u9", "q" * 1000), (9, "u9", "q" * 1000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, key string, size int")
    path = f"{Scratch(spark, 'test').base}/archive"
    write_archive(pages, path)
    got = Counter((r.record, r.record_type, r.refers_to) for r in read_records(spark, path).collect())
    plain = lambda k: (k, "response", None)
    assert got == Counter([plain("5"), ("1", "revisit", "5"), ("3", "revisit", "5"), plain("2"), plain("4"), plain("6"), plain("7"), plain("8"), ("-", "revisit", "8"), plain("9"), plain("9")])
    stored = read_payloads(spark, path).collect()
    assert len(stored) == 5 and all(r.payload_digest == hashlib.sha1(bytes(r.payload)).hexdigest() for r in stored)
    full = reconstruct(spark, path).collect()
    for r in full:
        head, body = bytes(r.warc).split(b"\r\n\r\n", 1)
        size = int(re.search(rb"Content-Length: (\d+)$", head)[1])
        assert len(body) == size + 4 and head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        assert re.search(rb"sha1:([0-9a-f]{40})", head)[1].decode() == hashlib.sha1(body[:size]).hexdigest()
        assert not re.search(rb"\r\nX: y", head)
    assert len(full) == len(rows)


def test_archive_detects_changed_bytes_and_takes_no_rows(spark):
    path = f"{Scratch(spark, 'test').base}/archive"
    pages = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    write_archive(pages.limit(0), path)
    assert reconstruct(spark, path).count() == 0
    spark.createDataFrame([("00", 4, bytearray(b"text"))], "key string, size long, payload binary").write.mode("append").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        read_payloads(spark, path).collect()


# -- licences -------------------------------------------------------------------------------------------


def test_licenses_equal_brute_force(spark, awkward, none):
    rng = random.Random(8)
    texts = [None, "", "MIT", *TEMPLATES.values()]
    for t in TEMPLATES.values():
        w = t.split()
        for _ in range(6):
            v = [x for x in w if rng.random() > 0.1] + ["extra"] * rng.randrange(3)
            texts.append("Before.\n\n" + " ".join(v).upper() + "\nAfter it\n")
            texts.append("\n".join([" ".join(v[: len(v) // 2]), " ".join(v[len(v) // 2 :])]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan(docs).collect()}
    hits = 0
    for k, t in enumerate(texts):
        found = []
        for u in units(t or ""):
            a = bigrams(u)
            for name, template in TEMPLATES.items():
                b = bigrams(template)
                dice = Fraction(2 * len(a & b), max(1, len(a) + len(b)))
                if dice >= Fraction(8, 10):
                    found.append((-dice, name))
        assert got[k].n_matches == len(found)
        assert got[k].license == (min(found)[1] if found else None)
        assert sorted(set(got[k].licenses)) == sorted({n for _, n in found})
        hits += bool(found)
    assert hits > 60
    assert license_scan(awkward).count() == awkward.count() and license_scan(none).count() == 0


def test_canonical_notices_are_found(spark):
    # written out here, not taken from TEMPLATES
    notices = {
        "Licensed under the Apache License, Version 2.0.": "Apache",
        "licensed under the apache license, version 2.0": "Apache",
        "Apache License, Version 2.0": "Apache",
        "Licensed under the Apache License 2.0.": "Apache",
        "Released under the MIT License.": "MIT",
        "This work is licensed under the GNU General Public License, version 3.": "GPL",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
        "All rights reserved.": "Reserved",
    }
    docs = spark.createDataFrame([(k, f"Some prose stands here.\n{t}\nMore prose follows it.") for k, t in enumerate(notices)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in license_scan(docs).collect()}
    assert all((got[k] or "").startswith(name) for k, name in enumerate(notices.values())), got


MIT_FILE = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
LGPL_FILE = """/*
 * Frobnicator, a library for frobnication.
 *
 * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 *
 * Written over many years by many hands, for whom no list is kept here.
 */
int main(void) { return 0; }"""


def test_embedded_notices_are_found(spark, awkward, none):
    rng = random.Random(4)
    prose = " ".join(f"w{rng.randrange(500)}x" for _ in range(3000))
    texts = {
        "Copyright 2020 Acme Inc. All rights reserved.": "Reserved",
        "This package is released under the MIT License, see LICENSE for details": "MIT",
        f"{prose} Licensed under the Apache License, Version 2.0. {prose}": "Apache",
        MIT_FILE: "MIT",
        LGPL_FILE: "LGPL",
        prose: None,
        "all of the rights and the terms of the software are under the license": None,
        "of the " * 5000: None,
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_stretches(docs).collect()}
    for k, (text, name) in enumerate(texts.items()):
        assert (got[k].license or "").startswith(name) if name else got[k].license is None, got[k]
        assert all(0 <= s.start < s.end <= len(text) for s in got[k].stretches)
    first = got[1].stretches[0]
    assert list(texts)[1][first.start : first.end] == "released under the MIT License"
    assert license_stretches(awkward).count() == awkward.count() and license_stretches(none).count() == 0


def test_bodies_of_long_licenses_are_found(spark):
    """A licence in a file: within other text, as a comment with marks, with one section changed, or a section alone."""
    scanner = StretchScanner(TEMPLATES | FULL_TEXTS | body_templates())
    for name in BODIES:
        text = pkgutil.get_data("rankweave.llm", f"license_bodies/{name}.txt").decode()
        parts = [n for n in scanner.sets if n.startswith(f"{name}-section-")]
        assert len(parts) > 3 or name == "CC0-1.0"
        marked = "some code\n" + "\n".join(f" * {line}" for line in text.split("\n")) + "\nmore code"
        found = scanner.scan(marked)
        assert {n for n, dice, _, _ in found if dice == 1.0} >= set(parts)
        for n, _, a, b in found:
            assert bigrams(marked[a:b]) & scanner.sets[n]
        third = sections(text)[len(parts) // 2]
        alone = {n for n, dice, _, _ in scanner.scan(f"words before {third} words after") if dice > 0.9}
        assert f"{name}-section-{len(parts) // 2 + 1}" in alone
    assert scanner.scan("the licensee of the software and the terms of this agreement for the use of the work " * 30) == []


def test_stretches_equal_all_windows():
    rng = random.Random(6)
    templates = {"one": "a b c d e f", "two": "b c a b c d a"}
    scanner = StretchScanner(templates)
    hits = 0
    for _ in range(400):
        words = [rng.choice("abcdefx") if rng.random() < 0.4 else "abcdefab"[k % 8] for k in range(rng.randrange(25))]
        got = scanner.scan("\n# ".join(words))
        for name, text in templates.items():
            b = bigrams(text)
            all_of = []
            for i in range(len(words)):
                for j in range(i + 2, min(len(words), i + 1 + scanner.reach[name]) + 1):
                    a = bigrams(" ".join(words[i:j]))
                    all_of.append(Fraction(2 * len(a & b), len(a) + len(b)))
            best = max(all_of, default=Fraction(0))
            mine = [m[1] for m in got if m[0] == name]
            assert bool(mine) == (best >= Fraction(8, 10)) and (not mine or max(mine) == float(best))
            hits += bool(mine)
    assert hits > 50
