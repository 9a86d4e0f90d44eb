import random
import re
from collections import Counter, defaultdict

from pagemill.llm import quality_rules as qr

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base_of(text):
    """The base columns by their definitions."""
    t = text or ""
    w = WORDS.findall(t)
    three = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    repeated = sum(x in lines[:i] for i, x in enumerate(lines))
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), repeated, len(covered), n < 50 or 100 * len(covered) > 50 * n


TEXTS = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x x x", "é日 \U0001f600x\n\n é日\n é日\x0b#|<b>", "l1 a\nl1 a\r\nl1 a\n \n", "one\x1ctwo\x85three\xa0four"]


def rows_of(seed=1):
    rng = random.Random(seed)
    texts = TEXTS + [" ".join(rng.choice("abcde") + rng.choice(["", "", "\n"]) for _ in range(rng.randrange(120))) for _ in range(40)]
    texts += [" ".join(rng.choice(["the", "quick", "brown", "foxes", "jumped"]) + str(rng.randrange(99)) for _ in range(rng.randrange(50, 200))) for _ in range(300)]
    junk = [" ".join(f"word{rng.randrange(999)}$$$" for _ in range(100)), "\n".join(["same line of text here again"] * 3 + [f"line {i} is another one of {i * 7}" for i in range(4)] * 1) + " " + " ".join(str(rng.random()) for _ in range(40)), " ".join(f"WORD{rng.randrange(999)}!!" for _ in range(100))]
    texts += junk
    return [(i, t, rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s1", "s2", None]), 0, "x") for i, t in enumerate(texts)], {len(texts) - 3, len(texts) - 1}


SCHEMA = "doc_id long, text string, lang string, source string, n_words int, kept string"


def test_measures():
    for t in TEXTS + [r[1] for r in rows_of(2)[0]]:
        assert qr.measure(None if t is None else t.encode())[:5] == base_of(t)[:5]


def least_at(values, quarters):
    v = sorted(values)
    need = -(-len(v) * quarters // 4)
    x = v[need - 1]
    low = max(0, x.bit_length() - 5)
    return x if x < 32 else x >> low << low


def test_judged_by_sketches(spark):
    rows, junk = rows_of()
    got = {r.doc_id: r for r in qr.judge(spark.createDataFrame(rows, SCHEMA), least=20).collect()}
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, t, lang, source, *_ in rows:
        *base, failed = base_of(t)
        r = got[i]
        assert [r[c] for c in qr.COUNTS[:5]] == base and r.base_failed == failed
        if not failed:
            for key in ((lang, source), (lang, "*"), ("*", "*")):
                groups[key].append(r)
    value = lambda r, a, b, scale: r[a] * scale // max(1, r[b])
    for i, t, lang, source, *_ in rows:
        r, failed = got[i], []
        if not r.base_failed:
            key = next((k for k in ((lang, source), (lang, "*")) if len(groups[k]) >= 20), ("*", "*"))
            for name, a, b, scale, side, slack in qr.RULES:
                q1, q2, q3 = (least_at([value(x, a, b, scale) for x in groups[key]], q) for q in (1, 2, 3))
                v = value(r, a, b, scale)
                if v > q2 + max(slack, qr.SPREADS * (q3 - q2)) or side == "both" and v < q2 - max(slack, qr.SPREADS * (q2 - q1)):
                    failed.append(name)
        assert r.failed_rules == failed
        assert r.kept == (not r.base_failed and not failed)
    assert not any(got[i].kept for i in junk)
    assert sum(r.kept for r in got.values()) >= 290


def test_merged_sketches_are_those_of_all_rows(spark):
    rows, _ = rows_of(3)
    stats = qr.measured(spark.createDataFrame(rows, SCHEMA)).selectExpr("*", "'a' as lang_tag", "pmod(doc_id, 5) as source_tag")
    merged = qr.sketches(stats).groupBy("rule", "bucket").sum("n").collect()
    whole = qr.sketches(stats.selectExpr("* except (source_tag)", "0 as source_tag")).select("rule", "bucket", "n").collect()
    assert Counter(map(tuple, merged)) == Counter(map(tuple, whole))


def test_repeated_rows_and_empty(spark):
    rows, _ = rows_of(4)
    df = spark.createDataFrame(rows[-5:] * 2, SCHEMA)
    assert len(qr.judge(df).collect()) == 10
    assert qr.judge(spark.createDataFrame([], SCHEMA)).count() == 0
