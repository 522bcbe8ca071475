"""The operators made of DataFrame functions, against their SQL on fixtures with odd rows, and their plans."""

import math
import random
import re

import duckdb
import pyarrow as pa
import pytest

from quarry.llm import chat_format as CF
from quarry.llm import license_scan as LS
from quarry.llm import quality_rules as QR


def duck(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted(repr(sorted(zip(names, map(plain, r)))) for r in cur.fetchall())


def plain(v):
    return round(float(v), 9) if isinstance(v, float) else v


def rows_of(df):
    return sorted(repr(sorted((c, plain(r[c])) for c in df.columns)) for r in df.collect())


def arrow(rows, **types):
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    return pa.table({c: pa.array([r[i] for r in rows], kinds[t]) for i, (c, t) in enumerate(types.items())})


def no_python(df):
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


ODD = [None, "", " \n\t\r", "one", "é è", "a\x0bb\x0cc", "x" * 200_000, "\n\n\n", "MIT LICENSE", "mit  license, mit-license", "mitlicense mit licenses"]


def texts(seed):
    rng = random.Random(seed)
    words = [rng.choice("abcdé") * rng.randint(1, 3) for _ in range(12)] + ["#", "the", "License", "MIT", "2.0"]
    out = list(ODD)
    for _ in range(150):
        line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))
        lines = [line() for _ in range(rng.randint(1, 20))]
        out.append("\n".join(lines + rng.choices(lines, k=rng.randint(0, 3))))
    return out


# ---------------------------------------------------------------- quality rules

def quality_frames(spark, n=700):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        bad = i % 10 == 0
        body = " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(40, 90)))
        text = (body + " #### $$$$ ****") * (1 if bad else 0) + body * (0 if bad else 1)
        docs.append((i, text, "en" if i % 3 else None))
        labels.append((i, 0 if bad else 1, 0))
    docs += [(None, "x y z", "en"), (3, "twice here", "en"), (3, "twice here", "en")] + [(1000 + i, t, "fr") for i, t in enumerate(texts(2))]
    labels += [(None, 1, 0), (5, 0, 0), (6, None, 0), (99999, 1, 0), (1001, 1, 0)]
    s = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 AS n_words", "'k' AS stratum")
    return s.repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs, labels


def test_quality_against_sql(spark, monkeypatch):
    monkeypatch.setattr(QR, "RISK", 0.05)
    s, lab, docs, labels = quality_frames(spark)
    got = QR.quality_verdicts(s, lab, risk=0.05)
    assert rows_of(got) == duck(QR.oracle_sql(), documents=arrow(docs, doc_id="long", text="string", lang="string"),
                                labels=arrow(labels, doc_id="long", quality="int", toxic="int"))
    assert any(r.failed_rules for r in got.collect())          # some cutoff is certified here
    no_python(got)
    kept = QR.quality_filter(s, lab, risk=0.05)
    assert kept.columns == s.columns and kept.count() == got.where("kept").count()


def test_quality_without_labels_or_rows(spark):
    s, lab, docs, _ = quality_frames(spark, 30)
    got = QR.quality_verdicts(s, lab.limit(0)).collect()
    assert len(got) == len(docs) and all(r.kept != r.base_failed for r in got)
    assert QR.quality_verdicts(s.limit(0), lab).collect() == []


def test_binomial_tail(spark):
    rows = [(n, k) for n in (0, 1, 5, 300, 2000, 5000) for k in (0, 1, 3, 20) if k <= n]
    df = spark.createDataFrame(rows, "n long, k long")
    got = {(r.n, r.k): r.x for r in df.select("n", "k", QR.tail_at_most(0.01, "0.002D").alias("x")).collect()}
    for n, k in rows:
        tail = sum(math.comb(n, j) * 0.01 ** j * 0.99 ** (n - j) for j in range(k + 1))
        assert got[n, k] == (n > 0 and tail <= 0.002), (n, k, tail)


def test_false_rejections_stay_within_the_bound(spark):
    """The share of good documents above a chosen cutoff never exceeds the risk in the holdout."""
    from pyspark.sql import functions as F
    s, lab, _, _ = quality_frames(spark)
    got = QR.quality_verdicts(s, lab, risk=0.05).join(lab.where("quality = 1").select("doc_id").distinct(), "doc_id").where("NOT base_failed")
    share = got.agg(F.avg((F.col("failed_rules") != "").cast("double"))).first()[0]
    assert share <= 0.05


def measured(n_words=100, word_chars=500, n_symbols=0, n_dup_lines=0, n_lines=10, n_repeat_words=0):
    return (n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words)


MEASURED = "stratum string, quality int, _quality struct<" + ", ".join(f"{m}: long" for m in QR.MEASURES) + ">"


def test_four_rules_together_stay_within_the_risk(spark):
    """Good documents hit by one rule each: the set's joint rejection is what is certified, per stratum."""
    from pyspark.sql import functions as F
    hits = [measured(n_symbols=200), measured(n_repeat_words=45), measured(n_dup_lines=8), measured(word_chars=1300)]
    few = [measured(n_symbols=200)] * 4 + [measured(n_repeat_words=45)]
    rows = [("many", 1, measured())] * 7936 + [("many", 1, h) for h in hits for _ in range(16)]      # 0.2 % by each, 0.8 % together
    rows += [("few", 1, measured())] * 7995 + [("few", 1, h) for h in few]
    rows += [("short", 1, measured())] * 500 + [(s, 0, h) for s in ("many", "few", "short") for h in hits for _ in range(20)]
    labelled = spark.createDataFrame(rows, MEASURED)
    cutoffs = QR.select_cutoffs(labelled)
    found = {r.stratum: r for r in cutoffs.collect()}
    assert "short" not in found                                # 500 good labels can't carry 0.5 %
    assert all(found["few"][r] is not None for r in QR.RULES)
    rejected = labelled.join(cutoffs, "stratum").where("quality = 1").groupBy("stratum").agg(F.avg(F.greatest(
        *[F.coalesce((QR.ratio(r) > F.col(r)).cast("int"), F.lit(0)) for r in QR.RULES]).cast("double")).alias("share"))
    shares = {r.stratum: r.share for r in rejected.collect()}
    assert all(x <= QR.RISK for x in shares.values()) and shares["few"] > 0


def test_sets_of_cutoffs_are_nested():
    for a, b in zip(QR.PATH, QR.PATH[1:]):
        assert all(a[r] is None or b[r] <= a[r] for r in QR.RULES) and a != b
    assert QR.PATH[-1] == {r: min(cuts) for r, (_, _, _, cuts) in QR.RULES.items()}


# ---------------------------------------------------------------- license scan

NOTICES = [t for ts in LS.TEMPLATES.values() for t in ts]


def license_docs():
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(texts(3))]
    for i, notice in enumerate(NOTICES * 3):
        w = notice.split()
        keep = [x for x in w if rng.random() > (i // len(NOTICES)) * 0.15]
        long = " ".join(f"z{rng.randrange(999)}" for _ in range(rng.choice([0, 5, 150])))
        rows.append((500 + i, f"{long} {', '.join(keep).title()}.\n{long}"))
    return rows + [(None, "mit license"), (7, "Apache License"), (7, "Apache License"),
                   (800, "general public LICENSE x apache-license é general  public\nlicense mit license")]


def test_license_against_sql(spark):
    rows = license_docs()
    s = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rank", "'b' AS labels", "0 AS at").repartition(3)
    got = LS.license_scan(s)
    assert rows_of(got) == duck(LS.oracle_sql(), documents=arrow(rows, doc_id="long", text="string"))
    no_python(got)
    assert LS.license_scan(s.limit(0)).collect() == []


def test_wrapped_notices(spark):
    """Hard-wrapped headers, comment signs in front, with other text around: the label comes as on one line."""
    rng = random.Random(9)
    rows = []
    for i, (label, notice) in enumerate((label, t) for label, ts in LS.TEMPLATES.items() for t in ts):
        for width in (3, 10):
            for lead in (0, 5, 31, 40, 63, 200):
                words = [f"z{rng.randrange(999)}" for _ in range(lead)] + notice.split() + [f"y{rng.randrange(999)}" for _ in range(rng.choice([0, 90]))]
                text = "\n".join(" * " + " ".join(words[j:j + width]) for j in range(0, len(words), width))
                rows.append((len(rows), text, label))
    got = {r.doc_id: r for r in LS.license_scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert all(label in got[i].labels.split(",") and got[i].score == 1.0 for i, _, label in rows)
    plain_rows = [(i, t) for i, t, _ in rows]
    assert rows_of(LS.license_scan(spark.createDataFrame(plain_rows, "doc_id long, text string"))) == duck(
        LS.oracle_sql(), documents=arrow(plain_rows, doc_id="long", text="string"))


def test_phrase_places(spark):
    text = "The MIT license; an Apache  license, mit-License and general public license. éMIT license mit licenses"
    r = LS.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    at = [i for i in range(len(words)) for p in LS.PHRASES if words[i:i + len(p.split())] == p.split()]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(at), min(at), max(at), "apache,gpl,mit")


# ---------------------------------------------------------------- chat formatting

def conversations():
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "ann", None]), rng.choice(["hi", "é\nx", "", None, "long " * 50]))
            for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "a"), (None, 1, "bob", "b"), (None, None, "bob", "c"), (77, 0, "system", "only"),
             (78, 0, "user", "again"), (78, 0, "user", "again"), (78, 0, "assistant", "tie")]
    return rows + [(99, t, f"p{t % 3}", f"turn {t}") for t in range(3000)]


def test_chat_against_sql(spark):
    rows = conversations()
    s = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS seq", "2 AS perspective")
    got = CF.rotate(s.repartition(6))
    assert rows_of(got) == duck(CF.oracle_sql(), conversations=arrow(rows, conv_id="long", turn="long", role="string", text="string"))
    no_python(got)
    assert CF.rotate(s.limit(0)).collect() == []


@pytest.mark.parametrize("conv", [99, 78])
def test_spans_lie_in_the_dialogue(spark, conv):
    s = spark.createDataFrame([r for r in conversations() if r[0] == conv], "conv_id long, turn long, role string, text string")
    by = {}
    for r in CF.rotate(s).collect():
        by.setdefault(r.perspective, []).append(r)
    assert set(by) == {r[2] for r in conversations() if r[0] == conv}
    for who, parts in by.items():
        parts.sort(key=lambda r: r.seq)
        whole = "".join(r.rendered for r in parts)
        assert [r.seq for r in parts] == list(range(len(parts)))
        for r in parts:
            assert whole[r.start:r.end] == r.rendered
            assert (r.mask_start is None) == (r.speaker != who)
            if r.mask_start is not None:
                assert whole[r.mask_start:r.mask_end].endswith("<|end|>\n") and r.tag == "assistant"
