import collections
import hashlib
import html
import math
import random
import re
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from barloom.llm import interleave, kd_shards, language_id, secret_scan

DATA = "/root/testdata/sf0.001"


def plain_tree(rows, shards):
    """Leaf by row of (keys, size): recursion at the weighted median of the widest dimension; a leaf is known by its first number."""
    out = {}
    whole = [max(1, max(k[i] for k, _ in rows) - min(k[i] for k, _ in rows)) for i in range(4)]

    def split(own, first, n):
        if n == 1 or not own:
            out.update(dict.fromkeys(own, first))
            return
        spread = [(max(rows[r][0][i] for r in own) - min(rows[r][0][i] for r in own)) / whole[i] for i in range(4)]
        dim = max(range(4), key=lambda i: (spread[i], -i))
        goal = sum(rows[r][1] for r in own) * (n // 2) / n
        by_key = collections.Counter()
        for r in own:
            by_key[rows[r][0][dim]] += rows[r][1]
        at = 0
        for key in sorted(by_key):
            up_to = at + by_key[key]
            if up_to >= goal:
                cut = key + 1 if up_to - goal < goal - at else key
                break
            at = up_to
        split([r for r in own if rows[r][0][dim] < cut], first, n // 2)
        split([r for r in own if rows[r][0][dim] >= cut], first + n // 2, n - n // 2)

    split(list(range(len(rows))), 0, shards)
    return out


def test_cuts_equal_plain_recursion(spark):
    rng = random.Random(2)
    docs = [(rng.randrange(900) if i % 7 else 5, "x" * int(rng.paretovariate(0.7) % 4000), rng.choice(["a", "b", None, "hot", "hot", "hot"]), rng.choice(["en", "de", None]), "k", 0) for i in range(400)]
    docs += [docs[3]] * 5 + [(1000, "y" * 300_000, "hot", "en", "k", 0), (None, None, None, None, "k", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, k0 string, node int")
    rows = kd_shards.metadata(df)
    held = [(tuple(r[f"k{i}"] for i in range(4)), r["size"]) for r in rows.collect()]
    for shards in (1, 5, 8):
        got = collections.Counter((tuple(r[f"k{i}"] for i in range(4)), r["size"], r["node"]) for r in kd_shards.partitioned(rows, shards, exact=0).collect())
        leaves = plain_tree(held, shards)
        assert got == collections.Counter((*held[i], leaf) for i, leaf in leaves.items())


def test_giant_documents_ties_and_names_in_shards(spark):
    docs = [(i, "z" * 100 if i % 3 else "same", "hot", None, 9, "law") for i in range(300)] + [(7, "g" * 1_000_000, "hot", "en", 9, "law")] * 2
    got = kd_shards.shard_report(spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, shard int, law string"), 6).collect()
    assert len(got) == 302 and {r["law"] for r in got} == {"bytes"}
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r["shard"] for r in got if r["size"] > 1000}) == 1  # equal rows share a shard


def plain_model(texts, smoothing=0.5):
    """Log ratios of pairs of characters: values of base rules against words without digits, each different text once."""
    place = lambda c: min(max(ord(c) - 32, 0), 95) if ord(c) < 0x110000 else 95
    counts = {k: np.full((96, 96), smoothing) for k in ("random", "ordinary")}
    for t in {t for t in texts if t is not None}:
        values = [m[2] for m in re.finditer(secret_scan.ASSIGN, t) if len(m[2]) >= 8]
        values += [m[0] for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        values += [m[0] for m in re.finditer(r"(?<![0-9a-f])[0-9a-f]+", t) if len(m[0]) >= 32]
        words = [m[0] for m in re.finditer(r"[A-Za-z0-9+/_=-]{8,}", t)]
        words = [w for w in words if not re.search(r"[0-9a-f]{32}|AKIA[A-Z0-9]{12}|[0-9]", w)]
        for kind, own in (("random", values), ("ordinary", words)):
            for v in own:
                for a, b in zip(v, v[1:], strict=False):
                    counts[kind][place(a), place(b)] += 1
    logs = {k: np.log(c / c.sum(1, keepdims=True)) for k, c in counts.items()}
    return logs["random"] - logs["ordinary"]


def test_markov_model_equals_a_plain_count(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r[0] for r in docs.select("text").collect()]
    want = plain_model(texts)
    got = np.array(secret_scan.train(docs, sample=10**9)).reshape(96, 96)
    assert np.abs(got - want).max() < 1e-3
    values = ["Zq8xW3rT9uVb2NmK7pLd", "thisIsAnOrdinaryIdentifier", "a_b-c/d=e+f", "x", ""]
    sums = spark.createDataFrame([(v,) for v in values], "v string").select(secret_scan.log_ratio(F.col("v"), got.ravel().tolist())).collect()
    plain = [sum(got[ord(a) - 32, ord(b) - 32] for a, b in zip(v, v[1:], strict=False)) for v in values]
    assert np.allclose([s[0] for s in sums], plain, atol=1e-6)


def test_markov_spans_find_planted_strings(spark):
    """Random strings of 24 to 40 characters among ordinary words joined to identifiers as long."""
    rng = random.Random(9)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = [w for r in docs.limit(200).select("text").collect() for w in re.findall(r"\b[a-z]{4,9}\b", r[0] or "")]
    planted, plain, rows = set(), set(), []
    for i in range(200):
        secret = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randint(24, 40)))
        name = rng.choice(["_", "-", "/"]).join(rng.choice(words) for _ in range(5))
        planted.add(secret)
        plain.add(name)
        rows.append((i, f"{rng.choice(words)} {secret} {name} {rng.choice(words)}"))
    found = secret_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string"), secret_scan.train(docs))
    got = {s["value"] for r in found.collect() for s in r["secrets"]["spans"]}
    recall, wrong = len(got & planted) / len(planted), len(got & plain) / len(plain)
    assert recall > 0.9 and wrong < 0.05, (recall, wrong)


def plain_ranks(texts, size):
    counts = collections.Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in (t or "").lower())):
            w = f" {w} "
            counts.update(g for n in (1, 2, 3) for i in range(len(w) - n + 1) if (g := w[i : i + n]).strip() and (n < 3 or g[1] != " "))
    code = lambda g: sum((1 if c == " " else ord(c)) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:size]]


def test_predictions_equal_plain_distances(spark):
    rows = duckdb.sql(f"select doc_id, text, lang from '{DATA}/documents.parquet'").fetchall()
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    profiles = {}
    for lang in {la for _, _, la in rows if la}:
        learnt = {t for i, t, la in rows if la == lang and not held[i] and t is not None}
        profiles[lang] = {g: k for k, g in enumerate(plain_ranks(learnt, 400))}
    got = {r["doc_id"]: r for r in language_id.predicted(spark.read.parquet(f"{DATA}/documents.parquet"), per_language=10**9).collect()}
    for i, t, _ in rows:
        own = plain_ranks([t], 400)
        if not own:
            assert got[i]["lang_pred"] == "und"
            continue
        away = {la: sum(abs(p[g] - k) if g in p else 400 for k, g in enumerate(own)) for la, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        assert got[i]["lang_pred"] == best and math.isclose(got[i]["score"], 1 - away[best] / (400 * len(own))) and got[i]["held_out"] == held[i]


def plain_reader(image):
    """Pixels of an RGB PNG by the format's own rules, filters none and sub to average left out: 8 bits, no interlace."""
    assert image[:8] == b"\x89PNG\r\n\x1a\n"
    at, data, head = 8, b"", None
    while at < len(image):
        size, kind = int.from_bytes(image[at : at + 4], "big"), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + size]
        assert zlib.crc32(kind + body) == int.from_bytes(image[at + 8 + size : at + 12 + size], "big")
        head = body if kind == b"IHDR" else head
        data += body if kind == b"IDAT" else b""
        at += 12 + size
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    assert head[8:] == bytes([8, 2, 0, 0, 0])
    raw = zlib.decompress(data)
    lines = [raw[y * (3 * width + 1) : (y + 1) * (3 * width + 1)] for y in range(height)]
    assert all(line[0] == 0 for line in lines)
    return b"".join(line[1:] for line in lines)


def test_images_and_features_by_another_reader(spark):
    texts = ["", None, "a", "x" * 192, "x" * 193, "é漢\U0001f600" * 100, "\0" * 10]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    media = {r["digest"]: bytes(r["media"]) for r in interleave.media_store(docs).collect()}
    for r in interleave.media_report(docs).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        image = media[hashlib.sha256(raw).hexdigest()]
        pixels = plain_reader(image)
        assert pixels == raw + b" " * (-len(raw) % 192 if raw else 192) and r["payload_bytes"] == len(pixels) and r["media_bytes"] == len(image)
        sums = [sum(pixels[c::3]) for c in range(3)]
        levels = [sum(1 for p in pixels if p // 32 == k) for k in range(8)]
        assert r["feature"] == f"rgb={','.join(map(str, sums))};levels={','.join(map(str, levels))}"


def test_sequences_of_real_pages_keep_their_order(spark):
    """Texts, figures and captions put into real pages come out at their places, and their payloads with them."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet").limit(20).collect()
    payloads = {hashlib.sha256(t.encode()).hexdigest(): t for t in ("one", "two", "three")}
    one, two, three = payloads
    figure = lambda d, c: f"<figure><img src='sha256:{d}'><figcaption>{c}</figcaption></figure>"
    rows = [(p["page_id"], p["html"].replace("</h1>", f"</h1>{figure(one, 'first &amp; foremost')}<p>between</p><img alt='plain' src='sha256:{two}'>", 1).replace("</article>", f"{figure(three, 'last')}{figure('0' * 64, 'unknown')}</article>", 1)) for p in pages]
    media = spark.createDataFrame([(d, len(t)) for d, t in payloads.items()], "digest string, n int")
    got = collections.defaultdict(list)
    for r in interleave.resolved(spark.createDataFrame(rows, "page_id long, html string"), media, "page_id").orderBy("id", "pos").collect():
        got[r["id"]].append((r["pos"], r["kind"], r["text"], r["caption"], r["media"]["n"] if r["media"] else None, r["parts"]))
    for page_id, text in rows:
        parts = got[page_id]
        assert [p[0] for p in parts] == list(range(len(parts))) and {p[5] for p in parts} == {len(parts)}
        shown = [(p[3], p[4]) for p in parts if p[1] == "media"]
        assert shown == [("first & foremost", 3), ("plain", 3), ("last", 5), ("unknown", None)]
        at = next(i for i, p in enumerate(parts) if p[1] == "media")
        assert parts[at + 1][2] == "between" and parts[at - 1][1] == "text"
        plain = re.sub(r"<(script|style)[^>]*>.*?</\1>|<!--.*?-->|<figcaption>.*?</figcaption>|<!DOCTYPE[^>]*>", "", text, flags=re.S)
        words = html.unescape(re.sub(r"<[^>]*>", " ", plain)).split()
        assert "".join(words) == "".join("".join(p[2].split()) for p in parts if p[1] == "text")


def test_report_with_pages_equals_that_without(spark):
    docs = spark.createDataFrame([(0, "a"), (1, None), (1, "b"), (2, "a"), (None, "c"), (9, "x" * 500)], "doc_id long, text string")
    pages = spark.createDataFrame([(0, "<p>t</p><img src='x'>", "u"), (0, None, "u"), (1, "<script>never closed", "u"), (9, "<!-- open", "u"), (77, "<p>no document", "u"), (None, "<p>", "u")], "page_id long, html string, digest string")
    key = lambda r: tuple(str(r[c]) for c in ("doc_id", "payload_sha256", "media_sha256", "feature", "caption"))
    with_, without = interleave.media_report(docs, pages).collect(), interleave.media_report(docs).collect()
    assert sorted(map(key, with_)) == sorted(map(key, without)) and len(with_) == 6
    assert sorted((str(r["doc_id"]), r["parts"]) for r in with_ if r["doc_id"] in (0, 2)) == [("0", 5), ("2", 3)]
