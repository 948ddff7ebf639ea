"""Secret scan with a random forest that removes false positives, in DataFrame expressions alone.

Candidates are values assigned to a telling name, passwords in URLs and long runs of key-like characters with a digit. A
quoted value goes up to its closing quote on the line, whatever it holds (escaped quotes included); one without quotes, or
whose quote isn't closed on the line, goes up to white space, without the marks at its end. Each is
described by its length, character classes and transitions, dictionary coverage, path marks and neighbouring
words; a forest trained on labelled findings scores it, compiled to nested conditions. Everything happens within
the row of a document: no shuffle, no join, no row for each candidate, so neither a hot source nor a long text
needs care beyond its own row.

Training fits a few small trees on a bounded table of labelled findings (value, before, after, label); the default
one is made by rule from hashes of row numbers, at most ``FINDINGS`` rows. Features of findings and of candidates come from
the same expressions.

A value has no largest length. Its head, up to the first quote, comma, semicolon or angle bracket, is judged beside the
whole, and the higher score holds for the whole, so that what stands after a mark never stays in the text alone. A quoted
value with more than ``ESCAPES`` escapes is taken like one without quotes. A value of more than ``PIECE`` characters is described in pieces of that length, since
shares of characters mean little in longer ones; its score is its highest piece's, and it is reported and redacted whole.

Texts are matched in a few passes, whatever the number of candidates, and secrets are redacted in one pass by a pattern
that branches by their first characters. A text without a candidate costs two passes.

Defined results: null and empty texts have no candidates, an empty table gives no rows; equal values in a text are one
candidate, judged everywhere they stand by the words about each place: the highest score holds, and all are redacted,
within longer words too; of secrets that begin at one place the longest goes; ties go by the value's order; rows repeat
as they are; columns other than doc_id and text pass through ``redact_secrets`` unchanged, whatever their names. Texts
of any length are read whole, by the task that has their row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FINDINGS, TREES, DEPTH, SEED, THRESHOLD, CONTEXT, PIECE, SHORTEST = 2880, 9, 5, 3, 0.5, 48, 200, 4
ESCAPES = 1000
REDACTED = "[SECRET]"
#: Names that announce a secret, and words that stand by harmless values of the same look.
NAMES = r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key"
HARMLESS = r"example|sample|dummy|placeholder|test|sha1|sha256|md5|checksum|digest|commit|revision|uuid|guid|hash|version|isbn|order|phone|invoice|build|etag"
#: Common words and word parts that random strings rarely hold.
DICTIONARY = "about account after and any build change check code config data default demo document error example file first for from group hello home image index info into item key last line link list local login main message model name network news number object open order page part pass password path phone photo place port post press print public query read report request sample secret server service session set sign start state string system table temp test text the this time title token type update upload user value version video view with word work world your".split()
KNOWN = r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_|^sk_(?:live|test)_|^xox[abpr]-|^AIza|^eyJ"
AFTER = rf"(?=((?s:.{{0,{CONTEXT}}})))"
RUN_VALUE, NAMED = r"(?<![A-Za-z0-9+/_\-])([A-Za-z0-9+/_\-]{16,}={0,2})", rf"(?i)(?:{NAMES})[\"']?\s{{0,3}}[=:]"
RUN = RUN_VALUE + AFTER
HEAD = rf"^[^\"',;<>]{{6,{PIECE}}}(?=[\"',;<>])"
_PLAIN = r"\S{5,}[^\s,;.:)\]}\"'<>]"


def _quoted(q: str) -> str:
    """After an opening quote: what stands before the closing one on the line, else what stands before white space."""
    closed = rf"(?=[^{q}\r\n]{{6}}|[^{q}\r\n]*\\)[^{q}\\\r\n]*+(?:\\[^\r\n][^{q}\\\r\n]*+){{0,{ESCAPES}}}+(?={q})"
    return rf"(?<={q})(?:{closed}|(?![^{q}\r\n]*{q}){_PLAIN}|(?=(?:[^\\\r\n]*\\){{{ESCAPES + 1}}}){_PLAIN})"


#: The value is looked at, not taken, so that an assignment within a longer value is a match too.
ASSIGNED = rf"{NAMED}\s{{0,3}}[\"']?(?=({_quoted(chr(34))}|{_quoted(chr(39))}|(?<![\"'])(?![\"']){_PLAIN}){AFTER})"
CREDENTIAL = rf"(?i)[a-z][a-z0-9+.\-]{{1,30}}://[^\s/?#:@]*+:(?=([^\s/?#]{{4,}})(?=@[^\s/?#@]){AFTER})"


def candidates(text: Column) -> Column:
    """array<struct<value, before, after>> of a text, one for each place where a candidate stands."""
    none = F.array().cast("array<struct<value:string,before:string,after:string>>")
    runs = F.when(text.rlike(RUN_VALUE), F.filter(_matches(text, RUN, True), lambda c: c["value"].rlike("[0-9]"))).otherwise(none)
    told = F.when(text.rlike(NAMED), _matches(text, ASSIGNED, False)).otherwise(none)
    return F.concat(told, runs, F.when(text.rlike("://[^\\s/?#]*:[^\\s/?#]*@"), _matches(text, CREDENTIAL, False)).otherwise(none))


def _matches(text: Column, pattern: str, taken: bool) -> Column:
    """Candidates by the groups 1 (value) and 2 (after); the value is ``taken`` by the match or follows it.

    What stands before is joined from the ends of the text's parts, matched and unmatched, up to the value: each part
    is read a bounded number of times, however many matches there are. No match takes fewer than ``SHORTEST`` characters.
    """
    group = lambda n: F.regexp_extract_all(text, F.lit(pattern), F.lit(n))
    end = lambda part: F.right(part, F.lit(CONTEXT))
    most = 2 * (CONTEXT // SHORTEST + 1)

    def parts(m: Column) -> Column:
        return F.flatten(F.transform(m["between"], lambda b, i: F.array(end(b), end(F.coalesce(F.get(m["matched"], i), F.lit(""))))))

    def described(m: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            upto = 2 * i + (1 if taken else 2)
            before = end(F.array_join(F.slice(m["parts"], F.greatest(upto - most, F.lit(0)) + 1, F.least(upto, F.lit(most))), ""))
            return F.struct(v.alias("value"), before.alias("before"), F.get(m["after"], i).alias("after"))

        return F.transform(m["value"], one)

    # arrays of one bind what is worked out once for a text
    found = F.array(F.struct(F.split(text, pattern, -1).alias("between"), group(0).alias("matched"), group(1).alias("value"), group(2).alias("after")))
    found = F.transform(found, lambda m: F.struct(parts(m).alias("parts"), m["value"].alias("value"), m["after"].alias("after")))
    return F.coalesce(F.flatten(F.transform(found, described)), F.array().cast("array<struct<value:string,before:string,after:string>>"))


def features(c: Column | dict[str, Column]) -> list[tuple[str, Column]]:
    """Numbers that describe a candidate (value, before, after)."""
    value, before, after = c["value"], c["before"], c["after"]
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    words = "|".join(sorted(DICTIONARY, key=len, reverse=True))
    flag = lambda condition: condition.cast("double")
    return [
        ("length", n),
        ("digits", share("[0-9]")), ("upper", share("[A-Z]")), ("lower", share("[a-z]")), ("marks", share("[^A-Za-z0-9]")),
        ("transitions", share("(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]")),
        ("distinct", F.size(F.array_distinct(F.split(value, ""))) / n),
        ("repeats", share(r"(.)\1{2,}")),
        ("dictionary", (n - F.length(F.regexp_replace(F.lower(value), words, ""))) / n),
        ("vowel_runs", share("(?i)[bcdfghjklmnpqrstvwxyz][aeiou][bcdfghjklmnpqrstvwxyz]")),
        ("path", flag(before.rlike(r"[/\\.]$") | value.rlike(r"/.+/") | after.rlike(r"^(?:[/\\@]|\.[a-z]{2,4}\b)"))),
        ("named", flag(before.rlike(rf"(?i)(?:{NAMES})\W{{0,6}}$"))),
        ("near_name", flag(F.concat(before, F.lit(" "), F.substring(after, 1, 24)).rlike(rf"(?i)(?:{NAMES})"))),
        ("harmless", flag(before.rlike(rf"(?i)(?:{HARMLESS})\W{{0,6}}(?:\w{{1,12}}\W{{1,3}})?$"))),
        ("known", flag(value.rlike(KNOWN))),
        ("credential", flag(before.rlike(r"://[^\s/?#:@]*:$") & after.startswith("@"))),
        ("uuid", flag(value.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"))),
    ]


def labelled_findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """(value, before, after, label): findings made by rule from hashes of row numbers; half are secrets."""
    word = lambda k: f"element_at(array({', '.join(map(repr, DICTIONARY))}), cast(pmod(xxhash64(id, {k}), {len(DICTIONARY)}) + 1 as int))"
    pick = lambda k, *xs: f"element_at(array({', '.join(map(repr, xs))}), cast(pmod(xxhash64(id, {k}), {len(xs)}) + 1 as int))"
    hex_ = "sha2(cast(id as string), 256)"
    upper = "upper(translate(sha2(concat('k', id), 256), '0123456789', 'GHJKLMNPQ7'))"
    mixed = "replace(base64(unhex(sha2(concat('m', id), 256))), '=', '')"
    secret = f"""case id % 8 when 6 then substr({mixed}, 1, 8 + cast(pmod(xxhash64(id), 9) as int)) when 7 then concat(substr({mixed}, 1, 6), {pick(11, ';', ',', '<', ' ', '>', '!,')}, substr({mixed}, 9, 4 + cast(pmod(xxhash64(id), 12) as int))) when 0 then substr({hex_}, 1, 16 + cast(pmod(xxhash64(id), 9) as int)) when 1 then concat('AKIA', substr({upper}, 1, 16)) when 2 then substr({hex_}, 1, 40)
        when 3 then substr({mixed}, 1, 20 + cast(pmod(xxhash64(id), 23) as int)) when 4 then concat('ghp_', substr(translate({mixed}, '+/', 'ab'), 1, 36)) else concat(substr({mixed}, 1, 7), '!', substr({hex_}, 1, 5)) end"""
    told = f"""case id % 8 when 6 then concat({word(1)}, ' ', {pick(12, 'postgres', 'https', 'amqp', 'ftp')}, '://', {word(2)}, ':') when 7 then concat({word(1)}, ' ', {pick(3, 'password="', 'token = "', "secret: 'x".replace("'x", '"'), 'api_key="')}) when 1 then concat({word(1)}, ' ', {word(2)}, ' ') when 4 then concat({word(1)}, ' ')
        else concat({word(1)}, ' ', {pick(3, 'password=', 'token = "', 'secret: ', 'api_key=', 'passwd = ', 'auth_token: ', 'PASSWORD=', 'access_key="')}) end"""
    plain = f"""case id % 12 when 10 then concat({word(4)}, ' ', {word(5)}, {pick(13, ' ', ', ')}, {word(6)}, ' ', {word(7)}) when 11 then {pick(14, 'password', 'secret', 'pass', 'passwd', 'your_password', 'xxxx')} when 0 then concat({word(4)}, '_', {word(5)}, '_', {word(6)}, '_', cast(pmod(xxhash64(id), 100) as string)) when 1 then substr({hex_}, 1, 40)
        when 2 then concat(substr({hex_}, 1, 8), '-', substr({hex_}, 9, 4), '-', substr({hex_}, 13, 4), '-', substr({hex_}, 17, 4), '-', substr({hex_}, 21, 12))
        when 3 then concat({word(4)}, '/', {word(5)}, '/', {word(6)}, cast(id as string)) when 4 then cast(pmod(xxhash64(id), 9000000000000000) + 1000000000000000 as string)
        when 5 then repeat({pick(7, 'x', '0', 'a1', '*', 'xX')}, 16) when 6 then concat({word(4)}, {word(5)}, {word(6)}, cast(pmod(id, 1000) as string)) when 7 then concat({word(4)}, '-', {word(5)}, '-', {word(6)}, '-2024')
        when 8 then concat('your_', {word(5)}, '_here') else concat({word(4)}, {word(5)}) end"""
    near = f"""case id % 12 when 10 then {pick(3, 'password: "', 'the secret: "', 'token = "')} when 11 then concat({word(1)}, ' ', {pick(12, 'postgres', 'https', 'amqp', 'ftp')}, '://', {pick(15, 'user', 'name', 'admin')}, ':') when 1 then concat({pick(8, 'commit ', 'sha1: ', 'checksum ', 'revision ', 'md5 = ', 'etag: ')}) when 5 then {pick(3, 'password=', 'token = "', 'example ', 'secret: ')} when 8 then {pick(3, 'password=', 'token: ', 'api_key=')}
        when 9 then {pick(3, 'password=', 'token: ', 'the password: ', 'secret: ')} when 3 then concat({word(1)}, '/') else concat({word(1)}, ' ', {word(2)}, ' ') end"""
    base = spark.range(rows).selectExpr("id div 2 as id", "id % 2 as label").selectExpr(f"case when label = 1 then {secret} else {plain} end as value", f"case when label = 1 then {told} else {near} end as before", "id", "label")
    return base.selectExpr("value", "before", f"concat(case when before like '%://%' then '@' when before like '%\"' or id % 3 = 0 then '\"' else '' end, case when before like '%://%' then '' else ' ' end, {word(9)}) as after", "cast(label as int) as label")


@dataclass
class Tree:
    """A split (feature, at most) with two branches, or a leaf with the share of secrets."""

    share: float
    feature: int = -1
    limit: float = 0.0
    low: Tree | None = None
    high: Tree | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    """Least Gini impurity over a random part of the features."""
    node = Tree(float(y.mean()))
    if not depth or len(y) < 8 or node.share in (0.0, 1.0):
        return node
    best = (1e-9, -1, 0.0)
    base = node.share * (1 - node.share) * len(y)
    for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1])) + 1), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], np.cumsum(y[order])
        at = (v[1:] > v[:-1]).nonzero()[0]
        if len(at):
            n = at + 1.0
            left, right = t[at], t[-1] - t[at]
            gain = base - left * (1 - left / n) - right * (1 - right / (len(y) - n))
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), int(f), float((v[at[k]] + v[at[k] + 1]) / 2))
    if best[1] < 0:
        return node
    node.feature, node.limit = best[1:]
    low = x[:, node.feature] <= node.limit
    node.low, node.high = grow(x[low], y[low], depth - 1, rng), grow(x[~low], y[~low], depth - 1, rng)
    return node


def train_forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> list[Tree]:
    """Trees over bootstrap samples of ``findings`` (value, before, after, label), a bounded table that is read to the driver."""
    c = F.struct(*(F.coalesce(F.col(n), F.lit("")).alias(n) for n in ("value", "before", "after")))
    rows = findings.select(F.array(*(e for _, e in features(c))).alias("x"), F.col("label").cast("int").alias("y"), F.xxhash64("value", "before", "after").alias("h")).orderBy("h", "y").collect()
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows], float)
    rng = np.random.default_rng(SEED)
    out = []
    for _ in range(trees):
        pick = rng.integers(0, len(y), len(y))
        out.append(grow(x[pick], y[pick], depth, rng))
    return out


def _compiled(tree: Tree, x: Column) -> Column:
    if tree.feature < 0:
        return F.lit(tree.share)
    return F.when(x[tree.feature] <= tree.limit, _compiled(tree.low, x)).otherwise(_compiled(tree.high, x))


def pieces(value: Column) -> Column:
    """A value in pieces of ``PIECE`` characters that cover it, the last one up to its end; shorter values are one piece."""
    cut = F.concat(F.regexp_extract_all(value, F.lit(f"(?s).{{{PIECE}}}"), F.lit(0)), F.array(F.right(value, F.lit(PIECE))))
    return F.when(F.length(value) <= PIECE, F.array(value)).otherwise(cut)


def findings(text: Column, forest: list[Tree]) -> Column:
    """array<struct<value, score>> of all candidates of a text, by value."""
    def scored(c: Column) -> Column:
        judged = F.array_distinct(F.concat(pieces(c["value"]), F.regexp_extract_all(c["value"], F.lit(HEAD), F.lit(0))))
        x = F.transform(judged, lambda p: F.array(*(e for _, e in features({"value": p, "before": c["before"], "after": c["after"]}))))
        return F.struct(c["value"].alias("value"), F.array_max(F.transform(x, voted)).alias("score"))

    def voted(x: Column) -> Column:
        total = F.lit(0.0)
        for tree in forest:
            total = total + _compiled(tree, x)
        return total / len(forest)

    # of equal values the last has the highest score
    each = F.array(F.array_sort(F.transform(candidates(text), scored)))
    return F.flatten(F.transform(each, lambda fs: F.filter(fs, lambda f, i: ~F.coalesce(F.get(fs, i + 1)["value"] == f["value"], F.lit(False)))))


def scan_secrets(docs: DataFrame, forest: list[Tree] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_candidates, n_secrets, secrets) for every row of ``docs``; secrets are in order of value."""
    forest = forest or train_forest(labelled_findings(docs.sparkSession))
    found = docs.select("doc_id", findings(F.col("text").cast("string"), forest).alias("found"))
    secrets = F.transform(F.filter("found", lambda f: f["score"] >= threshold), lambda f: f["value"])
    return found.select("doc_id", F.size("found").alias("n_candidates"), secrets.alias("secrets")).select("doc_id", "n_candidates", F.size("secrets").alias("n_secrets"), "secrets")


def any_pattern(values: Column, branches: int = 3) -> Column:
    """A pattern for any of the values (distinct, of more than ``branches`` characters), the longest first; it branches by single characters."""
    quoted = lambda v: F.regexp_replace(v, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    if not branches:
        longest = F.array_sort(F.transform(values, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("value"))))
        return F.array_join(F.transform(longest, lambda v: quoted(v["value"])), "|")

    def branch(head: Column) -> Column:
        rest = F.transform(F.filter(values, lambda v: F.substring(v, 1, 1) == head), lambda v: F.substring(v, F.lit(2), F.length(v)))
        return F.concat(quoted(head), F.lit("(?:"), any_pattern(rest, branches - 1), F.lit(")"))

    return F.array_join(F.transform(F.array_distinct(F.transform(values, lambda v: F.substring(v, 1, 1))), branch), "|")


def redact_secrets(docs: DataFrame, forest: list[Tree] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every secret in text replaced by ``REDACTED``."""
    forest = forest or train_forest(labelled_findings(docs.sparkSession))
    text = F.col("text").cast("string")
    secrets = F.transform(F.filter(findings(text, forest), lambda f: f["score"] >= threshold), lambda f: f["value"])
    # an array of one binds the secrets, which are worked out once
    clean = F.transform(F.array(secrets), lambda s: F.when(F.size(s) > 0, F.regexp_replace(text, any_pattern(s), F.lit(REDACTED))).otherwise(text))[0]
    return docs.withColumn("text", F.when(text.isNull(), text).otherwise(clean))
