"""Text functions and rules against values worked out by hand."""

from pyspark.sql import functions as F

from quillgraph.functions import predicates as P
from quillgraph.functions import text as T


def values(spark, column, *rows, names="a"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ", ".join(f"{n} string" for n in names))
    return [r[0] for r in df.select(column).collect()]


def test_names(spark):
    a = F.col("a")
    assert values(spark, T.normalize_name(a), "cbt", "a-b_c/d", " x  y! ", None, "post-traumatic") == ["COGNITIVE BEHAVIORAL THERAPY", "A B C D", "X Y", "", "POST TRAUMATIC"]
    assert values(spark, T.canonical_name(a), "panic attacks", "(PTSD)", "") == ["PANIC ATTACK", "POST TRAUMATIC STRESS DISORDER", ""]
    assert values(spark, T.compact_name(a), "a b-c") == ["ABC"]
    assert values(spark, T.is_garbage(a), "THE OF", "AB", "SUPPORT CARE", "VARIOUS PILLS", "MULTIPLE SLEEP PROBLEM", "FATIGUE") == [True, True, True, True, False, False]


def test_derived_names(spark):
    got = values(spark, T.derived_name(F.col("a"), F.col("b"), F.col("c")), ("12%", "PREVALENCE_STATEMENT", "Twelve  in a hundred."), ("course", "COURSE_FEATURE", "It lasts."), ("Rare", "PREVALENCE_STATEMENT", "x y"), names="abc")
    assert got == ["TWELVE IN A HUNDRED", "IT LASTS", "RARE"]


def test_strength(spark):
    assert values(spark, T.strength_of(F.col("a")), "true", "7", "7.5", "6.5", "high", "8/10", None, "99", "-3", "none", "Very Strong") == [5, 7, 8, 6, 8, 8, 5, 10, 1, 5, 9]


def test_labels(spark):
    a = F.col("a")
    assert values(spark, T.structured_label(a), "who__ptsd__x.md", "C:\\a\\nimh__bipolar-disorder__y.md", "plain.md") == ["WHO: PTSD", "NIMH: Bipolar Disorder", ""]
    assert values(spark, T.document_name(a), "/x/my_doc.filtered.md", "", None) == ["my doc", "Unknown Document", "Unknown Document"]
    assert values(spark, T.section_label(a), "**What** / is", "", "==> picture x", "a\\b", " - ") == ["What > is", "General Section", "General Section", "a > b", "General Section"]
    assert values(spark, T.source_label(F.lit(None), a, F.lit("WHO")), "who__depression__1.md") == ["WHO: Depression"]
    assert values(spark, T.section_title(a), "[CONTEXT: x]\n\n## **Signs**\ntext", "") == ["Signs", "General Section"]
    assert values(spark, T.strip_context(a), "[CONTEXT: x]\n\nbody", "[CONTEXT: x]", "body") == ["body", "[CONTEXT: x]", "body"]
    assert values(spark, T.slug(a), " Ab--C d! ") == ["ab-c-d"]
    assert values(spark, T.excerpt(a, 10), "abc  def ghijk", "short") == ["abc def..."[:10], "short"]


def test_safety(spark):
    got = values(spark, P.is_crisis(F.col("a")), "I want to kill myself", "What is suicidal behavior disorder?", "best pizza recipe", "What is depression?", "what is suicide, I feel hopeless", None)
    assert got == [True, False, False, False, True, False]


def test_intents_and_scope(spark):
    a = F.col("a")
    assert values(spark, P.relation_intent(a), "What are the symptoms?", "how do you distinguish a from b", "prevalence of x", "hello") == ["symptoms", "differential_diagnosis", "prevalence", "general"]
    assert values(spark, P.scope(a, F.lit(False)), "best pizza recipe", "What is depression?", "I feel tired") == ["OUT_OF_SCOPE", "IN_SCOPE", "IN_SCOPE"]


def test_chunk_rules(spark):
    long = "The patient shows a clinical pattern of sleep. " * 5
    text = F.col("a")
    got = values(spark, P.keep_reason(P.chunk_quality(text, F.lit(""))), "short", long, "plain words go on and on here. " * 8, "1234 5678 " * 30)
    assert [g.split(":")[0] for g in got] == ["too_short", "ok", "no_clinical_signal", "low_alpha_ratio"]
    assert values(spark, P.clean_chunk(text), "a\n\n\n\nb\npage 12\nxiv\n**==> picture [1 x 2] intentionally omitted <==**\ntail") == ["a\n\nb\ntail"]
    assert values(spark, P.discard_reason(text), "", "12", "Preface and index", "Symptoms") == ["empty_header", "page_marker_header", "discard_header:index", None]


def test_ngrams(spark):
    assert sorted(values(spark, T.ngrams(F.col("a"), 2), "a b c")[0]) == ["A", "A B", "B", "B C", "C"]
    assert values(spark, T.ngrams(F.col("a"), 2), None) == [[]]
