"""Personal data by weak supervision, in DataFrame functions alone.

Patterns find candidate spans of each kind.  Three kinds of labelers vote on a
candidate: form (checksum, value range or number of digits: for or against),
gazetteer (a list of names, countries, domains: for or against), and context
(words before the span that speak for its kind, words that speak against it).
Expectation-maximisation over the counts of (kind, votes) estimates how often
each labeler votes so on true and on false candidates, and with that the
probability that a candidate is personal data.  These probabilities are the
soft labels of a final naive Bayes classifier over features that the labelers
do not see as such: words around the span, its shape and its length, with the
form check.  Matches of the base kinds that pass their checks always count;
the classifier adds others that it is sure of.

One pass over the texts leaves the candidates of each document with a few
characters of context in an array of its row; texts are never shuffled.  What
is learnt from is counted by (kind, votes) and by (kind, feature, hash bucket),
both of bounded number, and the learnt numbers are constants in the last pass,
which works inside each row.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.common import text_or_empty
from curata.session import ensure_checkpoint_dir

BEFORE, AFTER = 40, 20  # characters of context
BUCKETS = 512  # hash buckets of a feature
ROUNDS = 25  # of expectation-maximisation
SMOOTH = 2.0  # candidates' weight that a bucket of the classifier starts with, at its kind's shares
SURE = 0.9  # least probability of an added span
STRETCH = 256  # array elements that are summed up together


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``pattern`` starts only where no earlier start of the same stretch could have matched, so that long stretches are
    read once; it gives the same leftmost matches as the plain pattern.  ``needs`` must occur in a text with a match.
    """

    name: str
    pattern: str
    needs: tuple[str, ...] = ()
    words: tuple[str, ...] = ()  # before the span: for
    base: bool = False


# Base kinds and their patterns as the contract gives them (first alternatives: possessive, no useless starts).
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", ("@",), ("mail", "email", "e-mail", "contact", "write", "reach"), True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", (".",), ("ip", "address", "host", "server", "login", "client", "from"), True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", (), ("card", "visa", "mastercard", "credit", "debit", "payment", "amex"), True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", ("+",), ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "dial"), True),
)
# Further kinds, patterns of high recall.
MORE = (
    Kind(
        "written_email",
        r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]++)++",
        ("at)", "at]"),
        ("mail", "email", "e-mail", "contact", "write", "reach"),
    ),
    Kind(
        "local_phone",
        r"(?<![0-9+(.-])(?<!\+[0-9]{1,3}[\x20.-]{1,2})\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
        (),
        ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "dial"),
    ),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", ("-",), ("ssn", "social", "security", "insurance", "tax", "passport")),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", (), ("iban", "account", "bank", "transfer", "bic")),
    Kind("person", r"(?<![A-Za-z])[A-Z][a-z]{1,20}\.?\x20[A-Z][a-z]{1,20}(?![A-Za-z])", (), ("name", "named", "signed", "author", "dear", "regards", "patient", "employee")),
)
KINDS = BASE + MORE
# Words before a span that speak against personal data.
AGAINST = ("version", "release", "order", "invoice", "isbn", "issn", "serial", "part", "section", "chapter", "sku", "tracking", "example", "sample", "build")
# Gazetteers.
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Herr", "Frau", "Monsieur", "Madame")
FIRST_NAMES = (
    "James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Matthew", "Anthony", "Mark", "Paul",
    "Steven", "Andrew", "Kenneth", "George", "Kevin", "Brian", "Edward", "Peter", "Henry", "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara",
    "Susan", "Jessica", "Sarah", "Karen", "Lisa", "Nancy", "Margaret", "Sandra", "Ashley", "Emily", "Anna", "Emma", "Laura", "Julia", "Maria", "Alice",
    "Hans", "Klaus", "Juergen", "Stefan", "Sabine", "Petra", "Ursula", "Pierre", "Jean", "Luc", "Marie", "Camille", "Carlos", "Juan", "Pedro", "Luis",
    "Carmen", "Lucia", "Sofia", "Giovanni", "Marco", "Paolo", "Chiara", "Ivan", "Olga", "Ahmed", "Fatima", "Wei", "Yuki", "Priya",
)
IBAN_COUNTRIES = ("AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "GR", "HU", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "RO", "SE", "TR")
MAIL_ENDINGS = ("com", "org", "net", "edu", "gov", "de", "fr", "es", "it", "uk", "ch", "at", "eu", "io", "info")

LABELERS = ("form", "gazetteer", "context", "against")
FEATURES = ("form", "left", "left2", "right", "shape", "length")
CANDIDATE = "array<struct<kind:int,start:int,stop:int,form:int,votes:int,features:array<int>>>"


# The expressions below are SQL text: as single Column calls a plan of nine kinds would take longer to write down than to run.


def _running(values: str) -> str:
    """Sums of all elements before each place of an array of int, and of all; stretches keep the work near the length."""
    before = lambda a: f"aggregate({a}, array(0), (acc, x) -> concat(acc, array(element_at(acc, -1) + x)))"
    stretches = f"transform(sequence(0, cast(floor(size({values}) / {STRETCH}) AS int)), b -> slice({values}, b * {STRETCH} + 1, {STRETCH}))"
    totals = f"transform({stretches}, s -> aggregate(s, 0, (acc, x) -> acc + x))"
    return f"""flatten(zip_with({stretches}, slice({before(totals)}, 1, size({stretches})),
      (s, off) -> transform(slice({before("s")}, 1, size(s)), x -> x + off)))"""


def _form(kind: str, x: str) -> str:
    """Whether a match passes the check of its kind; null for kinds without one."""
    digits = f"regexp_replace({x}, '[^0-9]', '')"
    if kind == "ip":  # at most 255, whatever the number of leading zeros
        part = "ltrim('0', p)"
        return f"forall(split({x}, '[.]'), p -> length({part}) <= 3 AND cast(concat('0', substr({part}, 1, 3)) AS int) <= 255)"
    if kind == "card":
        return f"(length({digits}) BETWEEN 13 AND 19 AND luhn_check(substr({digits}, 1, 19)))"
    if kind == "phone":
        return f"length({digits}) BETWEEN 9 AND 15"
    if kind == "email":
        return "true"
    if kind == "national_id":
        return f"NOT {x} RLIKE '^(000|666|9..)-|-00-|-0000$'"
    if kind == "iban":  # letters are the numbers from 10; the rearranged number is 1 modulo 97
        plain = f"replace({x}, ' ', '')"
        step = "CASE WHEN c = '' THEN acc WHEN c <= '9' THEN (acc * 10 + ascii(c) - 48) % 97 ELSE (acc * 100 + ascii(c) - 55) % 97 END"
        return f"aggregate(split(concat(substr({plain}, 5, 60), substr({plain}, 1, 4)), ''), 0, (acc, c) -> {step}) = 1"
    return "cast(null AS boolean)"


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _listed(kind: str, x: str) -> str:
    """Vote of the gazetteer: 1, -1, or 0 where the kind has none."""
    if kind == "person":
        return f"if(substring_index({x}, ' ', 1) IN {_in(TITLES + FIRST_NAMES)}, 1, -1)"
    if kind == "iban":
        return f"if(substr({x}, 1, 2) IN {_in(IBAN_COUNTRIES)}, 1, -1)"
    if kind in ("email", "written_email"):
        return f"if(lower(regexp_extract({x}, '([A-Za-z0-9-]+)$', 1)) IN {_in(MAIL_ENDINGS)}, 1, 0)"
    return "0"


def _any_word(words: tuple[str, ...]) -> str:
    return rf"r'(?:^|[^a-z0-9])(?:{'|'.join(words)})(?:[^a-z0-9]|$)'"


def _candidates(k: int, kind: Kind) -> str:
    """The candidates of one kind: kind, place, form check, votes and feature buckets.

    They come from its matches m, the pieces p between them and where each pair of both begins (the sums of t).  All are
    zipped first: what a lambda refers to by place could be worked out anew for every match.
    """
    m, p, t = (f"_pii_{c}{k}" for c in "mpt")
    n = f"size({m})"
    begins = f"if({n} > 0, {_running(t)}, cast(array() AS array<int>))"
    sides = f"arrays_zip({m}, slice({begins}, 1, {n}), slice({p}, 1, {n}), slice({p}, 2, {n}))"
    one = f"named_struct('x', z.{m}, 'at', z.`1` + length(z.`2`), 'b', lower(substr(z.`2`, -{BEFORE}, {BEFORE})), 'a', lower(substr(z.`3`, 1, {AFTER})))"
    place = f"transform({sides}, z -> {one})"
    if kind.name == "card":  # only numbers that can have 13 to 19 digits
        place = f"filter({place}, c -> length(c.x) BETWEEN 13 AND 37)"
    form = f"CASE WHEN {_form(kind.name, 'c.x')} THEN 1 WHEN ({_form(kind.name, 'c.x')}) IS NULL THEN 0 ELSE -1 END"
    context = f"if(c.b RLIKE {_any_word(kind.words)}, 1, 0)" if kind.words else "0"
    against = f"if(c.b RLIKE {_any_word(AGAINST)}, -1, 0)"
    words = r"filter(split(c.b, r'[^\p{L}0-9]+'), w -> w <> '')"
    judged = f"""transform({place}, c -> named_struct('x', c.x, 'at', c.at, 'a', c.a, 'form', {form}, 'list', {_listed(kind.name, 'c.x')},
      'context', {context}, 'against', {against}, 'words', {words}))"""
    shape = "regexp_replace(regexp_replace(regexp_replace(substr(c.x, 1, 64), '[0-9]+', '9'), '[A-Z]+', 'A'), '[a-z]+', 'a')"
    bucket = lambda x, seed: f"cast(pmod(xxhash64({seed}, {x}), {BUCKETS}) AS int)"
    word = lambda i: f"coalesce(get(c.words, size(c.words) - {i}), '')"
    right = r"regexp_extract(c.a, r'^[^\p{L}0-9]*([\p{L}0-9]*)', 1)"
    features = f"c.form + 1, {bucket(word(1), 1)}, {bucket(word(2), 2)}, {bucket(right, 3)}, {bucket(shape, 4)}, least(length(c.x), {BUCKETS - 1})"
    return f"""transform({judged}, c -> named_struct('kind', {k}, 'start', c.at, 'stop', c.at + length(c.x), 'form', c.form,
      'votes', (((c.form + 1) * 3 + c.list + 1) * 3 + c.context + 1) * 3 + c.against + 1, 'features', array({features})))"""


def candidates(docs: DataFrame, text_col: str, keep: list[str], kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """The kept columns and ``_pii``: the candidates of each whole text, kind by kind, by start."""
    kept = [f"`{c}`" for c in keep]
    none = "cast(array() AS array<string>)"
    matches, pieces, steps = [], [], []
    for k, kind in enumerate(kinds):
        there = " OR ".join(f"contains(_pii_text, '{mark}')" for mark in kind.needs) or "true"
        if kind.name == "card":  # shorter numbers are no matches that could pass, and use up no other's text
            there = r"_pii_text RLIKE r'[0-9][0-9\x20-]{11}'"
        matches.append(f"if({there}, regexp_extract_all(_pii_text, r'{kind.pattern}', 0), {none}) AS _pii_m{k}")
        pieces.append(f"if(size(_pii_m{k}) > 0, split(_pii_text, r'{kind.pattern}', -1), {none}) AS _pii_p{k}")
        # piece 0, match 0, piece 1, match 1, ...: match i starts after pieces 0 to i and matches 0 to i - 1
        steps.append(f"zip_with(_pii_m{k}, slice(_pii_p{k}, 1, size(_pii_m{k})), (x, y) -> length(x) + length(y)) AS _pii_t{k}")
    rows = docs.select(*[F.col(c) for c in kept], text_or_empty(text_col).alias("_pii_text"))
    rows = rows.selectExpr("*", *matches).selectExpr("*", *pieces).selectExpr("*", *steps)
    found = ", ".join(_candidates(k, kind) for k, kind in enumerate(kinds))
    return rows.selectExpr(*kept, f"cast(concat({found}) AS {CANDIDATE}) AS _pii")


def estimate(counts: dict[tuple[int, int], int], kinds: int, rounds: int = ROUNDS) -> tuple[dict[tuple[int, int], float], list[dict]]:
    """Expectation-maximisation over counts of (kind, votes): the probability of each, and the reliabilities by kind.

    A reliability is P(vote | true) and P(vote | false) of one labeler for the votes -1, 0 and 1.  Pseudo-counts say that
    labelers are right more often than not, which fixes what "true" means; a kind nobody votes on stays at 1/2.
    """
    places = len(LABELERS)
    vote = lambda code, w: code // 3 ** (places - 1 - w) % 3
    right = {1: (1.0, 1.0, 4.0), 0: (4.0, 1.0, 1.0)}  # pseudo-counts of the votes -1, 0, 1
    table = []
    for k in range(kinds):
        share = 0.5
        rate = [[[c / sum(right[z]) for c in right[z]] for z in (0, 1)] for _ in range(places)]
        own = [(code, n) for (kind, code), n in sorted(counts.items()) if kind == k]
        for r in range(rounds + 1):
            known = {}
            for code, _ in own:
                odds = math.log(share / (1 - share)) + sum(math.log(rate[w][1][vote(code, w)] / rate[w][0][vote(code, w)]) for w in range(places) if vote(code, w) != 1)
                known[code] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            if r == rounds:
                break
            share = (1 + sum(n * known[code] for code, n in own)) / (2 + sum(n for _, n in own))
            for w in range(places):
                for z in (0, 1):
                    held = list(right[z])
                    for code, n in own:
                        held[vote(code, w)] += n * (known[code] if z else 1 - known[code])
                    rate[w][z] = [h / sum(held) for h in held]
        table.append({"kind": k, "share": share, "rate": rate, "known": known})
    return {(t["kind"], code): q for t in table for code, q in t["known"].items()}, table


def _constant(values: list[float]) -> Column:
    """An array of doubles as one constant of the plan."""
    return F.split(F.lit(",".join(repr(v) for v in values)), ",").cast("array<double>")


def train(found: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> list[float]:
    """Weights of the span classifier: for each kind its bias, then BUCKETS log odds a feature.

    Two counts reach the driver: (kind, votes), at most 81 a kind, and soft labels by (kind, feature, bucket).
    """
    each = found.select(F.explode("_pii").alias("c"))
    counts = {(r["kind"], r["votes"]): r["n"] for r in each.groupBy("c.kind", "c.votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    known, _ = estimate(counts, len(kinds))
    codes = 3 ** len(LABELERS)
    soft = _constant([known.get((k, v), 0.5) for k in range(len(kinds)) for v in range(codes)])
    labelled = each.select("c.kind", "c.features", F.get(soft, F.col("c.kind") * codes + F.col("c.votes")).alias("q"))
    sums = (
        labelled.select("kind", "q", F.posexplode("features").alias("slot", "bucket"))
        .groupBy("kind", "slot", "bucket")
        .agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no"))
        .collect()
    )
    total = {(k, z): 1.0 for k in range(len(kinds)) for z in ("yes", "no")}
    for r in sums:
        if r["slot"] == 0:
            total[r["kind"], "yes"] += r["yes"]
            total[r["kind"], "no"] += r["no"]
    size = 1 + BUCKETS * len(FEATURES)
    weights = [0.0] * (size * len(kinds))
    for k in range(len(kinds)):
        weights[k * size] = math.log(total[k, "yes"] / total[k, "no"])
    for r in sums:
        k = r["kind"]
        share = total[k, "yes"] / (total[k, "yes"] + total[k, "no"])  # a bucket with few candidates says little
        yes, no = r["yes"] + SMOOTH * share, r["no"] + SMOOTH * (1 - share)
        weights[k * size + 1 + r["slot"] * BUCKETS + r["bucket"]] = math.log(yes / no) - math.log(share / (1 - share))
    return weights


def _number(k: int) -> Column:
    return F.size(F.filter("_pii_base", lambda c: c["kind"] == k)).cast("long")


def find_personal_data(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, kinds: tuple[Kind, ...] = KINDS, sure: float = SURE) -> DataFrame:
    """The kept columns (default: all) of every row, with the personal data of its whole text.

    Added: ``n_<kind>`` (long) for each base kind and ``base_sha256`` (lowercase hex of the base spans' list) from the
    matches that pass their checks, and ``spans``: these and the ones that the classifier adds.  A span is
    ``kind:start:end`` in code points, end exclusive; lists go by kind in the order of ``kinds``, then start, joined by
    commas.  Null and empty texts have no span, whatever is learnt from the others; very long texts are read whole.  Added columns replace kept ones of their
    name; repeated rows get equal results and count each in what is learnt.  Null ids are rows like others, an empty table gives an
    empty result.
    """
    keep = list(docs.columns) if keep is None else keep
    base = [k for k, kind in enumerate(kinds) if kind.base]
    added = [*[f"n_{kinds[k].name}" for k in base], "base_sha256", "spans"]
    keep = [c for c in keep if c.lower() not in added]
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    first = candidates(docs, text_col, keep, kinds)
    first.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(first.schema).parquet(path)
    weights = train(found, kinds)
    size = 1 + BUCKETS * len(FEATURES)
    held = _constant(weights)
    odds = lambda c: F.aggregate(
        F.transform(c["features"], lambda b, i: F.get(held, c["kind"] * size + 1 + i * BUCKETS + b)), F.get(held, c["kind"] * size), lambda acc, w: acc + w
    )
    is_base = lambda c: (c["kind"] < len(base)) & (c["form"] == 1)
    if base != list(range(len(base))):
        raise ValueError("base kinds come first")
    taken = F.filter("_pii", lambda c: is_base(c) | (odds(c) >= math.log(sure / (1 - sure))))
    names = F.array(*[F.lit(k.name) for k in kinds])
    written = lambda c: F.concat(F.get(names, c["kind"]), F.lit(":"), c["start"].cast("string"), F.lit(":"), c["stop"].cast("string"))
    out = found.withColumn("_pii_base", F.filter("_pii", is_base))
    return out.select(
        *[F.col(f"`{c}`") for c in keep],
        *[_number(k).alias(f"n_{kinds[k].name}") for k in base],
        F.sha2(F.array_join(F.transform("_pii_base", written), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(taken, written), ",").alias("spans"),
    )
