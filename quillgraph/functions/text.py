"""Text functions as column expressions; all run in the JVM. A null input gives the result of an empty one unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph import config as C


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The table's value for a key, else the key."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], key)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` mentions it."""
    return F.transform(F.array(value), lambda v: then(v))[0]


def collapse(text: Column) -> Column:
    """White space folded to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_name(text: Column) -> Column:
    """Upper case; a whole-string abbreviation spelled out; everything but A-Z and 0-9 to single spaces."""
    spelled = lookup(F.upper(F.coalesce(text, F.lit(""))), C.ABBREVIATIONS)
    return F.trim(F.regexp_replace(spelled, "[^A-Z0-9]+", " "))


def canonical_name(text: Column) -> Column:
    """The normalised name, abbreviations spelled out once more, its last word in the singular."""
    singular = lambda name: let(F.regexp_extract(name, r"(\S+)$", 1), lambda last: F.concat(F.substring(name, F.lit(1), F.length(name) - F.length(last)), F.when(last == "", "").otherwise(lookup(last, C.SINGULARS))))
    return let(normalize_name(text), lambda normal: let(lookup(normal, C.ABBREVIATIONS), singular))


def compact_name(text: Column) -> Column:
    return F.replace(normalize_name(text), F.lit(" "), F.lit(""))


def derived_name(name: Column, kind: Column, description: Column) -> Column:
    """The canonical name, or for placeholder statements and generic courses the normalised description's first 140 characters."""
    canon = canonical_name(name)
    told = F.trim(F.substring(normalize_name(collapse(F.coalesce(description, F.lit("")))), 1, 140))
    vague = ((kind == "PREVALENCE_STATEMENT") & is_placeholder(canon, kind)) | ((kind == "COURSE_FEATURE") & canon.isin("COURSE FEATURE", "COURSE", "DEVELOPMENT AND COURSE"))
    return F.when(vague & (told != ""), told).otherwise(canon)


def is_garbage(name: Column) -> Column:
    """Names of stop words and filler alone, of two letters at most, or of one or two words with filler among them."""
    filler = lambda w: w.isin(C.FRAGMENTS)
    # sets of words that stay are looked up, not built anew for each name
    judged = lambda words: (F.size(words) == 0) | (F.length(name) <= 2) | F.forall(words, filler) | ((F.size(words) <= 2) & F.exists(words, filler))
    return let(F.array_distinct(F.filter(F.split(F.upper(name), r"\s+"), lambda w: (w != "") & ~w.isin(C.GRAPH_STOP_WORDS))), judged)


def is_numericish(name: Column) -> Column:
    return ~normalize_name(name).rlike("[A-Z]")


def is_placeholder(name: Column, kind: Column) -> Column:
    n = normalize_name(name)
    return n.isin(C.GENERIC_NAMES) | n.startswith("DIAGNOSTIC CRITERION") | (kind.isin("PREVALENCE_STATEMENT", "CONDITION") & is_numericish(n))


def is_low_signal(name: Column, kind: Column) -> Column:
    n = normalize_name(name)
    return n.isin(C.LOW_SIGNAL_NAMES) | n.contains(C.LOW_SIGNAL_PART) | ((kind == "TREATMENT") & (n.startswith("SCREENING FOR ") | n.endswith(" EVALUATION")))


def priority(kind: Column, table: dict[str, int] | None = None) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in (table or C.TYPE_PRIORITY).items() for x in kv])[kind], F.lit(0))


def strength_of(value: Column) -> Column:
    """1 to 10 from a JSON scalar as text: numbers rounded half to even, words by table, else the first digits, else 5."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    clamp = lambda x: F.greatest(F.lit(1), F.least(F.lit(10), x)).cast("int")
    words = F.create_map(*[F.lit(x) for kv in C.STRENGTH_WORDS.items() for x in kv])
    digits = F.regexp_extract(v, r"(\d+)", 1)
    number = F.when(v.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), clamp(F.bround(v.cast("double"))))
    return F.when(v.isin("", "true", "false"), 5).otherwise(F.coalesce(number, words[v], F.when(digits != "", clamp(digits.cast("double"))), F.lit(5)))


def strip_fences(text: Column) -> Column:
    """Without a Markdown code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))


def json_payload(text: Column, schema: str) -> Column:
    """A payload parsed as it is, or from its first { to its last }; null where neither parses."""
    parsed = lambda t: F.when(F.get_json_object(t, "$").isNotNull(), F.from_json(t, schema))
    return let(strip_fences(text), lambda plain: F.coalesce(parsed(plain), let(F.regexp_extract(plain, r"(?s)(\{.*\})", 1), parsed)))


def tokens(text: Column) -> Column:
    """All runs of a-z and 0-9 in lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def eval_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) > 2))


def search_tokens(text: Column) -> Column:
    """Longer tokens without stop words, repeats kept."""
    return F.filter(tokens(text), lambda t: (F.length(t) > 2) & ~t.isin(C.TOKEN_STOPWORDS))


def keyword_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) > 2) & ~t.isin(C.KEYWORD_STOPWORDS)))


def ngrams(text: Column, most: int = 5) -> Column:
    """Distinct n-grams of one to ``most`` words of the normalised text."""

    def of(words: Column) -> Column:
        def grams(n: int) -> Column:
            runs = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
            return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))

        return F.array_distinct(F.flatten(F.array(*(grams(n) for n in range(1, most + 1)))))

    return let(F.filter(F.split(normalize_name(text), " "), lambda w: w != ""), of)


def excerpt(text: Column, limit: int = 420) -> Column:
    compact = collapse(F.coalesce(text, F.lit("")))
    return F.when(F.length(compact) <= limit, compact).otherwise(F.concat(F.rtrim(F.substring(compact, 1, limit - 3)), F.lit("...")))


def strip_markdown(text: Column) -> Column:
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[([^\]]+)\]\([^)]*\)", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"<[^>]+>", " "), r"[*_`~]+", "")
    return collapse(F.regexp_replace(F.regexp_replace(out, "[™®]", " "), "[‐-―]", "-"))


def normalize_header(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(strip_markdown(text)), r"[^a-z0-9]+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/\\]*)[/\\]*$", 1)


def document_name(path: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(basename(path), r"(?i)\.filtered(?=\.md$)", ""), r"(?i)\.(md|markdown|txt)$", "")
    name = collapse(F.regexp_replace(name, "_+", " "))
    return F.when(name == "", "Unknown Document").otherwise(name)


def pretty_fragment(text: Column) -> Column:
    words = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), "[-_ ]+"), lambda w: w != "")
    shown = lambda w: F.coalesce(F.create_map(*[F.lit(x) for kv in C.SOURCE_ACRONYMS.items() for x in kv])[F.lower(w)], F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000))))
    return F.array_join(F.transform(words, shown), " ")


def structured_label(path: Column) -> Column:
    """``AUTH: Condition`` from a name of the form auth__condition__id; empty otherwise."""
    parts = F.filter(F.split(F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", ""), "__"), lambda p: p != "")
    a, b = pretty_fragment(F.get(parts, F.lit(0))), pretty_fragment(F.get(parts, F.lit(1)))
    return F.when((F.size(parts) >= 2) & (a != "") & (b != ""), F.concat(a, F.lit(": "), b)).otherwise("")


def legacy_label(name: Column) -> Column:
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    first, rest = F.lower(F.get(words, F.lit(0))), pretty_fragment(F.get(words, F.lit(1)))
    known = (F.size(words) >= 2) & first.isin("dsm", "nimh", "who")
    return F.when(known, F.when(rest == "", F.upper(first)).otherwise(F.concat(F.upper(first), F.lit(": "), rest))).otherwise("")


def section_label(text: Column, fallback: str = C.GENERAL_SECTION) -> Column:
    """A section's name from a header or a path of headers; picture marks and empty names give the fallback."""
    edge = lambda c: F.regexp_replace(c, r"^[ \-:/]+|[ \-:/]+$", "")
    flat = lambda raw: collapse(F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, "\r", " "), "\n", " / "), "[*`_]+", ""))
    parts = lambda f: F.filter(F.transform(F.split(f, r"[\\/]+"), edge), lambda p: p != "")
    joined = lambda raw: let(flat(raw), lambda f: let(parts(f), lambda p: edge(collapse(F.when(F.size(p) > 0, F.array_join(p, " > ")).otherwise(f)))))
    omitted = lambda raw: F.lower(raw).contains("intentionally omitted") | F.lower(raw).contains("==> picture")
    return let(F.trim(F.coalesce(text, F.lit(""))), lambda raw: let(joined(raw), lambda j: F.when((raw == "") | omitted(raw) | (j == ""), fallback).otherwise(j)))


def source_label(title: Column, file_name: Column, authority: Column) -> Column:
    """Title or label, else a structured name, else a legacy slug, else the document's name; the authority before it."""
    title, file_name, who = (F.trim(F.coalesce(c, F.lit(""))) for c in (title, file_name, authority))
    named = F.when(title == "", "").otherwise(document_name(title))
    formed = let(named, lambda n: let(structured_label(file_name), lambda s: F.when((s != "") & ~n.contains(":"), s).otherwise(n)))
    known = let(formed, lambda c: let(legacy_label(c), lambda g: F.when((c != "") & ~c.contains(":") & (g != ""), g).otherwise(c)))
    chosen = let(known, lambda c: F.when(c == "", document_name(file_name)).otherwise(c))
    return let(chosen, lambda c: F.when((who != "") & ~c.startswith(F.concat(who, F.lit(":"))), F.concat(who, F.lit(": "), c)).otherwise(c))


def citation_label(label: Column, section: Column) -> Column:
    return let(section_label(section), lambda name: F.when(name == C.GENERAL_SECTION, label).otherwise(F.concat(label, F.lit(" — "), name)))


def section_title(text: Column) -> Column:
    """The first line that is neither blank nor a context line, as a section's name of 120 characters at most."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("[CONTEXT:"))
    first = let(lines, lambda ls: F.when(F.size(ls) > 0, ls[0]).otherwise(""))
    return F.substring(section_label(F.regexp_replace(first, r"^#+\s*", "")), 1, 120)


def strip_context(text: Column) -> Column:
    """Without a leading context line and the blank lines after it; a text of that line alone stays."""
    return F.when(text.rlike(r"(?s)^\[CONTEXT:[^\n]*\n.*\S"), F.regexp_replace(text, r"^\[CONTEXT:[^\n]*\n\s*", "")).otherwise(text)


def fallback_context(source: Column, section: Column) -> Column:
    """The deterministic context sentence."""
    told = lambda about: F.when((about != "") & (about != C.GENERAL_SECTION), F.concat(F.lit(" and focuses on "), about, F.lit(" in a mental health reference."))).otherwise(" and provides mental health reference context.")
    return F.concat(F.lit("This passage is from "), source, let(F.coalesce(section, F.lit("")), told))


def relation_line(relation: Column, name: Column, description: Column, strength: Column) -> Column:
    """A list item for a target: statements by description alone, explained kinds with it, others by name; then the strength."""
    told = F.trim(F.coalesce(description, F.lit("")))
    explained = relation.isin("HAS_DIAGNOSTIC_CRITERION", "COMORBID_WITH", "DIFFERENTIAL_DIAGNOSIS", "HAS_SPECIFIER", "HAS_RISK_FACTOR")
    base = F.when(relation.isin("HAS_PREVALENCE", "HAS_COURSE") & (told != ""), told).when(explained & (told != ""), F.concat(name, F.lit(": "), told)).otherwise(name)
    rated = F.when(F.coalesce(strength, F.lit(0)) != 0, F.concat(F.lit(" (strength "), strength.cast("string"), F.lit(")"))).otherwise("")
    return F.concat(F.lit("- "), base, rated)


def preferred(name: Column) -> Column:
    """What orders equivalent names: more words, then longer, then less punctuation, then the name."""
    return F.struct(F.regexp_count(name, F.lit(" ")), F.length(name), -F.regexp_count(name, F.lit("[^A-Za-z0-9 ]")), name)
