import collections
import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest

from barloom.llm import fill_middle, filter_audit, personal

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, part string, mask string, fim string, digest string, personal string"
LABELS = "doc_id long, quality int, toxic int, text string"
MARKED = "holds <S> itself"
HARD = ["", None, "a", " \n\t ", "word " * 250, "word " * 250, "LOUD AND CLEAR", "a#b", "ä" * 300, "\U0001f600a\U0001f600bc1" * 40, "<P", "x<", MARKED, "one two. three! " * 30, "\0 nul", "z" * 700]


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(i, t, [None, "en", "", "de"][i % 4], "p", "m", "f", "d", "x") for i, t in enumerate(HARD)]
    return spark.createDataFrame([*rows, rows[4], (None, "a", "en", *"pmfdx"), (2, "zz", None, *"pmfdx")], DOCS)


def failures(rows):
    """Plainly: (part, failed filters) of rows (doc_id, text, lang)."""
    out = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = doc_id is not None and any((t or "") == text and i is not None and i < doc_id for i, t, _ in rows)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)), copy]
        out.append((lang or "", {n for n, f in zip("ABCDE", fails) if f}))
    return out


def test_audit_equals_going_through_every_order(spark, hard):
    labels = [(0, 1, 0, "x"), (0, None, 1, "x"), (4, 1, None, "x"), (5, 0, 1, "x"), (7, None, None, "x"), (99, 1, 1, "x"), (None, 1, 1, "x")]
    docs = [tuple(r) for r in hard.select("doc_id", "text", "lang").collect()]
    good, toxic = ({r[0] for r in labels if r[c] == 1 and r[0] is not None} for c in (1, 2))
    judged, want = failures(docs), collections.Counter()
    total = collections.Counter()
    for (doc_id, _, _), (part, fails) in zip(docs, judged, strict=True):
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                key = (part, "".join(order), step)
                here = f in fails and not gone
                want[key, "removed"] += here
                want[key, "redundant"] += f in fails and gone
                want[key, "unique"] += fails == {f}
                want[key, "good"] += here and doc_id in good
                want[key, "toxic"] += here and doc_id in toxic
                total[part, f] += here
                gone |= here
                want[key, "kept"] += not gone
    got = filter_audit.filter_audit(hard, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 600 * len({p for p, _ in judged})
    for r in got:
        key = (r["part"], r["filter_order"], r["step"])
        assert (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"]) == tuple(want[key, n] for n in ("kept", "removed", "redundant", "unique", "good", "toxic"))
        assert r["shapley"] == total[r["part"], r["filter_order"][r["step"] - 1]]


def test_audit_of_an_empty_table_and_of_other_filters(spark, hard):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.filter_audit(hard.limit(0), labels).count() == 0
    rows = spark.createDataFrame([("p", 1, 0, 0), ("p", 3, 1, 0), ("q", 0, 0, 1)], "part string, mask int, good int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"]) for r in filter_audit.audited(rows, "XY").collect()}
    assert got == {("p", "XY", 1): (0, 2), ("p", "XY", 2): (0, 0), ("p", "YX", 1): (1, 1), ("p", "YX", 2): (0, 1), **{("q", o, s): (1, 0) for o in ("XY", "YX") for s in (1, 2)}}


def test_table_of_first_failures():
    table = filter_audit.first_failures(5)
    assert table.shape == (32, 120)
    for mask, (j, order) in itertools.product(range(32), enumerate(itertools.permutations(range(5)))):
        assert table[mask, j] == next((s for s, f in enumerate(order) if mask >> f & 1), 5)


def filled(doc_id, text):
    """Plainly: n, form, prefix, middle, output."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    i, j = sorted(x % (len(units) + 1) for x in (h1, h2))
    a, b, z = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    return (len(units), "spm", len(a), len(b), f"<S>{z}<P>{a}<M>{b}") if h4 % 100 < 20 else (len(units), "psm", len(a), len(b), f"<P>{a}<S>{z}<M>{b}")


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_fill_middle_equals_plain_cuts(spark, hard, chunk):
    rng = random.Random(chunk)
    more = [(100 + i, "".join(rng.choice(["ab", "Z", "é", " ", "<", "\U0001f600", "S", "1"]) for _ in range(rng.randrange(60))), None, *"pmfdx") for i in range(150)]
    docs = hard.unionByName(spark.createDataFrame(more, DOCS))
    text = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = collections.Counter()
    for doc_id, t in docs.select("doc_id", "text").collect():
        n, form, a, b, out = filled(doc_id, t or "")
        want[doc_id, n, form, a, b, text(out), text(t or "")] += 1
    assert collections.Counter(tuple(r) for r in fill_middle.fim_report(docs, chunk).collect()) == want
    assert {x[2] for x in want} == {"plain", "psm", "spm"}


def test_fill_middle_keeps_columns(spark, hard):
    rows = fill_middle.transformed(hard, 5, out_col="made")
    assert rows.columns == [*hard.columns, "made"] and rows.count() == hard.count()
    assert {r["fim"] for r in rows.collect()} == {"f"}
    assert fill_middle.fim_report(hard.limit(0)).count() == 0


def test_chunks_compose_in_any_grouping():
    import pyarrow as pa

    rng = random.Random(3)
    for _ in range(300):
        parts = ["".join(rng.choice("aZ é1") for _ in range(rng.randrange(5))) for _ in range(6)]
        one = fill_middle.Scan(pa.array(parts, pa.large_string()))
        whole = fill_middle.Scan(pa.array(["".join(parts)], pa.large_string()))
        for entry in (0, 1):
            state, n = entry, 0
            for i in range(6):
                state, n = one.to[i, state], n + one.count[i, state]
            assert (state, n) == (whole.to[0, entry], whole.count[0, entry])


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def holds(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            total = sum(sum(divmod(int(d) * (2 if i % 2 else 1), 10)) for i, d in enumerate(reversed(digits)))
            return 14 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    return sorted((m.start(), k, m.end()) for k, kind in enumerate(personal.KINDS) for m in re.finditer(PLAIN[kind], text) if holds(kind, m[0]))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(11)
    for _ in range(20000):
        text = "".join(rng.choice(["a", "b.c", "@", "@@", ".", "1", "25", "300", "4111111111111111", "+", "+1", " ", "-", "(", ")", "é", "%", "_", "10.0.0.1", "000"]) for _ in range(rng.randrange(25)))
        assert personal.base_spans(text) == plain_spans(text), text
    for text in duckdb.sql(f"select text from '{DATA}/documents.parquet' where text is not null").fetchall():
        assert personal.base_spans(text[0]) == plain_spans(text[0])


def test_segmentation_has_the_greatest_sum():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 9))
        spans = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if rng.random() < 0.5]
        if not spans:
            continue
        first, last = np.array(spans).T
        score = rng.integers(-4, 9, len(spans)).astype(float)
        best = 0.0
        for size in range(n + 1):
            for some in itertools.combinations(range(len(spans)), size):
                if all(last[a] <= first[b] or last[b] <= first[a] for a, b in itertools.combinations(some, 2)):
                    best = max(best, score[list(some)].sum())
        got = personal.best_segmentation(first, last, score)
        assert all(last[a] <= first[b] for a, b in zip(got, got[1:], strict=False))
        assert score[got].sum() == best if got else best == 0


def test_answers_do_not_depend_on_blocks():
    texts = [("call (017) 555-7713 or jane at mail dot org, " * 30) + "1" * 300 + " 10[.]0[.]0[.]7"]
    tokens = personal.Tokens(texts)
    key = lambda parts: sorted((int(f), int(e), tuple(a)) for p in parts for f, e, a in zip(*p, strict=True))
    assert key([personal.candidates(tokens, 0, len(tokens))]) == key([personal.candidates(tokens, k, min(k + 7, len(tokens))) for k in range(0, len(tokens), 7)])


@pytest.fixture(scope="module")
def field():
    texts = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where text is not null order by doc_id").fetchall()]
    train = [t for t in texts[:500] if personal.base_spans(t)][:100] + texts[:100]
    return personal.fitted([x for i, t in enumerate(train) for x in personal.labelled(t, i)]), texts[500:]


def test_field_finds_what_is_otherwise_written(field):
    weights, held_out = field
    rows = [x for i, t in enumerate(held_out) for x in personal.labelled(t, 5000 + i)]
    texts = [t for t, _ in rows]
    base = [personal.base_spans(t) for t in texts]
    added = personal.added_spans(texts, base, weights, 1.0)
    right = wrong = missed = 0
    for (_, gold), b, a in zip(rows, base, added, strict=True):
        right += len({*a} & {*gold})
        wrong += len({*a} - {*gold})
        missed += len({*gold} - {*a} - {*b})
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.85, (right, wrong, missed)
    whole = personal.added_spans(held_out, [personal.base_spans(t) for t in held_out], weights, 1.0)
    assert sum(map(len, whole)) < 0.02 * len(held_out)  # nothing there is otherwise written


def test_personal_report(spark, hard):
    texts = {0: "jane_doe@mail.example.com or +1 (017) 555-7713", 1: None, 2: "", 3: "1.2.3.4 " * 3, 4: "9" * 5000, 5: "a" * 100000 + "@", 6: "+49 30 12345678901234567890", 7: "4111 1111 1111 1111\U0001f600 x@y.z"}
    docs = spark.createDataFrame([(i, t, None, *"pmfdx") for i, t in [*texts.items(), (3, texts[3])]], DOCS)
    got = personal.personal_report(docs).collect()
    assert len(got) == 9
    for r in got:
        want = plain_spans(texts[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in personal.KINDS] == [sum(s[1] == i for s in want) for i in range(4)]
        names = [f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert {*names} <= {*r["spans"].split(",")} or not names
    assert personal.personal_report(hard.limit(0)).count() == 0
    assert personal.personal_report(hard.where("text is null")).count() == 1
    clean = personal.redacted(docs)
    assert clean.columns == docs.columns
    assert {r["text"] for r in clean.where("doc_id = 0").collect()} == {"<EMAIL> or <PHONE>"}
