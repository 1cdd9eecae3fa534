"""Scores and verdicts, detection of personal values, and columns with clashing names, against brute force."""

from __future__ import annotations

import ipaddress
import math
import random
import re
import struct
from collections import Counter
from datetime import date

import pytest
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestar.llm import jaccard, lines, packing, pii, quality, queries, secrets, suffixes, winnow
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def long_hash(value: int, seed: int = 42) -> int:
    return xxhash.xxh64_intdigest(struct.pack("<q", value), seed)


def test_quality_verdicts(spark: SparkSession) -> None:
    """Counts, ratios, scores, threshold and verdicts, worked out again in Python."""
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    buckets = 1 << 10
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    label = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect()}

    def grams(text: str | None) -> list[int]:
        h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in brute.WORD.findall(text or "")]
        pairs = [signed(long_hash(b, long_hash(a))) for a, b in zip(h, h[1:], strict=False)]
        return [x % buckets for x in h + pairs]

    raw, target = Counter(), Counter()
    for d, t in texts.items():
        raw.update(grams(t))
        if label.get(d) == (1, 0):
            target.update(grams(t))
    ratio = [math.log((target[b] + 1) / (target.total() + buckets)) - math.log((raw[b] + 1) / (raw.total() + buckets)) for b in range(buckets)]
    score = {d: sum(ratio[b] for b in grams(t)) / max(len(grams(t)), 1) for d, t in texts.items()}
    failed = {d: brute.quality(t)[-1] for d, t in texts.items()}
    good = [d for d in texts if label.get(d) == (1, 0) and not failed[d]]
    bad = [d for d in texts if label.get(d, (1, 0))[0] == 0 and not failed[d]]
    left_out = {d: score[d] for d in bad}
    for d in good:
        own = Counter(grams(texts[d]))
        up = target.total() / (target.total() - own.total())
        new = {b: math.log(((target[b] - k) * up + 1) / (target.total() + buckets)) - math.log((raw[b] + 1) / (raw.total() + buckets)) for b, k in own.items()}
        left_out[d] = sum(new[b] * k for b, k in own.items()) / own.total()
    steps = sorted({round(left_out[d], 6) for d in good + bad})
    keeps = lambda at, ids: sum(round(left_out[d], 6) >= at for d in ids)
    threshold = min((keeps(at, bad), at) for at in steps if 100 * keeps(at, good) >= 98 * len(good))[1]
    got = quality.judge(docs, labels, buckets=buckets).collect()
    assert max(abs(r["score"] - score[r["doc_id"]]) for r in got) < 2e-6
    sure = [r for r in got if abs(score[r["doc_id"]] - threshold) > 2e-6]
    assert len(sure) > 190 and all(r["kept"] == (not failed[r["doc_id"]] and score[r["doc_id"]] >= threshold) for r in sure)
    assert {r["doc_id"] for r in quality.keep(docs, labels, buckets=buckets).collect()} == {r["doc_id"] for r in got if r["kept"]}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def personal(token: str) -> str | None:
    """The kind of a value that stands alone."""
    if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", token):
        parts = [tuple(map(int, m.groups()))]
    elif m := re.fullmatch(r"(\d{1,2})\.(\d{1,2})\.(\d{4})", token):
        parts = [(int(m[3]), int(m[2]), int(m[1]))]
    elif m := re.fullmatch(r"(\d{1,2})/(\d{1,2})/(\d{4})", token):
        parts = [(int(m[3]), int(m[1]), int(m[2]))] if int(m[1]) <= 12 else [(int(m[3]), int(m[2]), int(m[1]))]
    elif re.fullmatch(r"\d{3}-\d\d-\d{4}", token):
        a, b, c = map(int, token.split("-"))
        return "ssn" if 0 < a < 900 and a != 666 and b and c else None
    elif re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", token):
        try:
            ip = ipaddress.IPv4Address(token)
        except ValueError:
            return None
        return "ip" if not (ip.is_loopback or ip.is_multicast or ip.is_link_local or ip in ipaddress.ip_network("10.0.0.0/8") or ip in ipaddress.ip_network("172.16.0.0/12") or ip in ipaddress.ip_network("192.168.0.0/16") or int(ip) >> 24 in (0, *range(224, 256))) else None
    elif re.fullmatch(r"\(?\d{3}\)?[ -]\d{3}-\d{4}", token):
        d = re.sub(r"\D", "", token)
        return "phone" if d[0] in "23456789" and d[3] in "23456789" else None
    elif re.fullmatch(r"[A-Z]{2}\d\d[A-Z0-9]{11,30}", token):
        return "iban" if pii.IBAN_LENGTH.get(token[:2]) == len(token) and int("".join(str(int(c, 36)) for c in token[4:] + token[:4])) % 97 == 1 else None
    elif re.fullmatch(r"[\d ]+", token) and 13 <= len(d := token.replace(" ", "")) <= 19:
        return "card" if luhn(d) and len(set(d)) > 1 else None
    elif re.fullmatch(r"[A-Za-z0-9][\w.+-]*@[a-z0-9-]+\.[a-z]{2,}", token):
        return "email"
    else:
        return None
    try:
        return "date" if 1900 <= date(*parts[0]).year <= 2099 else None
    except ValueError:
        return None


def test_personal_values_against_brute_force() -> None:
    rng, names, back = random.Random(3), pii.Pseudonyms(b"key"), pii.Pseudonyms(b"key", inverse=True)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def one() -> str:
        y, m, d = rng.randint(1890, 2110), rng.randint(0, 14), rng.randint(0, 33)
        card = rng.choice(["4", "5", "37"]) + digits(14)
        body = "".join(rng.choice("0123456789ABC") for _ in range(18))
        return rng.choice([
            f"{y}-{m:02}-{d:02}", f"{d}.{m}.{y}", f"{d:02}.{m:02}.{y}", f"{m}/{d}/{y}", f"{d:02}/{m:02}/{y}", f"{digits(3)}-{digits(2)}-{digits(4)}", ".".join(str(rng.choice([8, 10, 127, 172, 192, 203, 256, 31, 168])) for _ in range(4)),
            f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", card, card + pii.luhn_digit(card), f"DE{pii.iban_check('DE', body)}{body}", f"DE{digits(2)}{body}", "x" * rng.choice([3, 300]) + digits(2) + "@example.org", "word", digits(5),
        ])

    for _ in range(400):
        values = [one() for _ in range(6)]
        text = ", ".join(values)
        new, found = names.replace(text)
        assert [(k, text[a:b]) for k, a, b in found] == [(personal(v), v) for v in values if personal(v)], text
        assert back.replace(new)[0] == text
        changed = new.split(", ")
        for old, now in zip(values, changed, strict=True):
            if personal(old):
                assert personal(now) == personal(old) and (personal(old) == "ip" or pii.shape_of(now) == pii.shape_of(old)), (old, now)
            else:
                assert now == old
    spelled = [names.replace(x)[0] for x in ("2020-01-02", "1/2/2020", "01/02/2020", "2.1.2020")]
    day = date.fromisoformat(spelled[0])
    assert spelled[1:] == [f"{day.month}/{day.day}/{day.year}", f"{day.month:02}/{day.day:02}/{day.year}", f"{day.day}.{day.month}.{day.year}"]


CLASHING = ("_k", "_id", "_n", "hits", "_hashes", "_new", "_text", "_of", "_may", "_mark", "_key", "_gone", "_left", "c0", "id", "key", "tokens", "fp", "window", "at", "name", "_spans", "_items")


@pytest.mark.parametrize("operator", ["quality", "pii", "suffixes", "secrets", "jaccard", "lines", "winnow", "packing"])
def test_clashing_columns(spark: SparkSession, operator: str) -> None:
    """Columns of any name come back as they were."""
    texts = ["one two three four five six seven eight nine ten eleven", None, "", "a b c d e f g h i j k l m\nsecond line of some words and more of them here", "word " * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in CLASHING})
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, "word word word word word word word word word word")], "item_id bigint, text string")
    run = {
        "quality": lambda: quality.judge(docs, labels), "pii": lambda: pii.pseudonymize(docs, b"k"), "suffixes": lambda: suffixes.remove_repeats(docs), "secrets": lambda: secrets.scan(docs), "jaccard": lambda: jaccard.keep_each(docs),
        "lines": lambda: lines.dedup_lines(docs), "winnow": lambda: winnow.decontaminate(docs, bench), "packing": lambda: packing.pack_documents(docs, *queries.tokenizer()),
    }
    got = run[operator]()
    rows = got.collect()
    if operator == "packing":
        assert len(rows) == 5
        return
    assert set(docs.columns) <= set(got.columns) and len(rows) == (4 if operator == "winnow" else 5)
    assert all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in CLASHING)
    if operator == "quality":
        assert quality.keep(docs, labels).columns == docs.columns


def test_all_labels_count(spark: SparkSession) -> None:
    """Model and threshold come from every label: no number of them is cut off."""
    labels = spark.range(0, 120_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality", "0 AS toxic")
    assert quality.trusted_ids(labels).count() == 60_000
    assert [tuple(r) for r in quality.labelled_ids(labels).groupBy("good").count().orderBy("good").collect()] == [(0, 60_000), (1, 60_000)]


def test_texts_that_cannot_be_trusted_are_not_joined(spark: SparkSession) -> None:
    """Every trusted id is marked, and of the others hardly any, so their texts need no shuffle; without the text the numbers are the same."""
    docs = spark.range(-5_000, 5_000).selectExpr("id AS doc_id", "concat('a b c d e f g h i j k', id % 7, ' l', id % 3) AS text").unionByName(spark.createDataFrame([(None, "x y")], "doc_id bigint, text string"))
    labels = spark.range(-5_000, 5_000, 100).selectExpr("CAST(id AS INT) AS doc_id", "CAST(id % 200 = 0 AS INT) AS quality", "0 AS toxic")
    trusted = quality.trusted_ids(labels)
    marked = {r["doc_id"] for r in quality.with_mark(docs, trusted, "m").where("m").collect()}
    assert {r["doc_id"] for r in trusted.collect()} <= marked and len(marked) < 60
    whole, narrow = quality.judge(docs, labels), quality.judge(docs, labels, columns=["doc_id"])
    assert "text" in whole.columns and narrow.columns == [c for c in whole.columns if c != "text"]
    assert sorted(map(str, whole.drop("text").collect())) == sorted(map(str, narrow.collect()))


def test_quality_model_is_not_a_column(spark: SparkSession) -> None:
    """No row holds the tables over all buckets: copied into each, they took 1.5 MB of memory traffic a row."""
    docs = spark.createDataFrame([(i, "good words of a kind here * again\v" * 3, i % 2 == 0) for i in range(20)], "doc_id long, text string, m boolean")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 20, 2)], "doc_id long, quality int, toxic int")
    model = quality.fit_ratios(quality.bucket_counts(docs, quality.trusted_ids(labels), 64), 64)
    for scored in (quality.score(docs, model, 64), quality.score(docs, model, 64, "m")):
        plan = scored._jdf.queryExecution().optimizedPlan().toString()
        assert "scalar-subquery" in plan and not re.search(r"scalar-subquery#\d+ \[[^\]]*\]\S* AS ", plan)


def test_quality_windows_of_pairs(spark: SparkSession) -> None:
    """Windows are hashed from pairs: equal exactly where their 5 words are, also in texts of up to 5 words."""
    for text in ("", "a", "a b c d", "a b c d e", "a b c d e x a b c d e", "a b a b a b a b", "a b c d x a b c d y"):
        words = text.split()
        rows = spark.createDataFrame([(text,)], "text string").select(quality.hashes_of(F.col("text")).alias("h")).select(quality.joined(F.col("h"), 1).alias("p")).select(quality._windows(F.col("p"))).first()[0]
        want = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        assert [[x == y for y in rows] for x in rows] == [[x == y for y in want] for x in want]


def test_quality_counts_hash_each_text_once(spark: SparkSession) -> None:
    """Spark infers no filter by the number of n-grams, for which every text would be hashed a second time."""
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, "a")], "doc_id long, text string")
    counts = quality.bucket_counts(docs, spark.createDataFrame([(1,)], "doc_id long"), 64)
    filters = [line for line in counts._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in line]
    assert not [line for line in filters if "split(" in line]
    assert counts.agg(F.sum("raw"), F.sum("target")).first()[:] == (6, 5)
