"""Personal data in texts by weak supervision, with DataFrame functions only.

Base spans are fixed patterns with their checks and always stay. Looser patterns propose further candidates. Three
labelers vote on every span, base or proposed: its shape, affixes known from a gazetteer, and words before it. Votes
are counted by pattern, expectation-maximisation on those counts (a bounded table: votes x kinds) estimates how
reliable each labeler is, and a logistic classifier over coarse features of the span, trained on the posteriors of
all spans (again on counts, one row for each feature pattern), decides on the proposed spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, stored

KINDS = ("email", "ip", "card", "phone", "secret")

# The base patterns, written so that no long run is scanned twice (possessive where a longer match could
# only fail; a match starts inside a run of local-part characters only where the previous match ended).
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

# Proposals.
LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\[dot\]|\(dot\))\x20?)[A-Za-z0-9-]++)++"
LOOSE_PHONE = r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"
SECRET = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+"

# What the gazetteer and the context labeler know: endings of mail domains, first octets that are routed,
# issuers' first digits, calling codes by zone, first characters of access keys, and words that announce each kind in
# English, Spanish, French and German.
DOMAINS = "com org net edu gov mil int info biz name pro io co ai app dev cloud tech online site store shop blog me tv cc de at ch fr es it pt nl be lu uk ie se no dk fi is pl cz sk hu ro bg gr tr ru ua br mx ar cl pe us ca au nz jp kr cn hk tw sg in il za eu asia example test"
CALLING = "1 7 20 27 3[0-4] 36 39 4[013-9] 5[1-8] 6[0-6] 8[1246] 9[0-58] 2[1-6][0-9] 29[0-9] 35[0-9] 37[0-9] 38[0-9] 42[0-9] 50[0-9] 59[0-9] 67[0-9] 68[0-9] 69[0-2] 80[08] 85[0-9] 87[0-8] 88[0-8] 96[0-8] 97[0-9] 99[2-8]"
KEYS = "AKIA ASIA AIza ghp_ gho_ ghu_ ghs_ github_pat_ glpat- sk_live_ sk_test_ pk_live_ rk_live_ sk- xoxa- xoxb- xoxp- xoxs- npm_ pypi- dop_v1_ hf_ eyJ ya29 SG. shpat_ sq0atp- EAAC LTAI"
AFFIX = {
    "email": rf"(?i)(?:\.|dot[\])]\x20?)(?:{DOMAINS.replace(' ', '|')})$",
    "ip": r"^(?!0|127\.)(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.",
    "card": r"^(?:4|5[1-5]|3[0-689]|6(?:011|4[4-9]|5)|2[2-7]|35|62)",
    "phone": rf"^(?:\+(?:{CALLING.replace(' ', '|')})|\(?[2-9][0-9]{{2}})",
    "secret": rf"^(?:{KEYS.replace('.', chr(92) + '.').replace(' ', '|')})",
}
WORDS = {
    "email": "e-?mail mail contact write reach correo escriba contacto courriel contacter kontakt schreiben",
    "ip": "ip host addr address server client login node gateway servidor serveur adresse knoten",
    "card": "card visa mastercard amex credit debit payment tarjeta pago carte paiement karte zahlung",
    "phone": "phone call tel telephone mobile cell fax whatsapp sms llame telefono m[oó]vil appeler portable anrufen handy telefon",
    "secret": "token secret key apikey api_key passw(?:or)?d pwd bearer auth authorization credential clave cl[eé] schl[uü]ssel",
}
CONTEXT = {kind: rf"(?i)(?<![A-Za-z])(?:{x.replace(' ', '|')})[^A-Za-z0-9]{{0,6}}$" for kind, x in WORDS.items()}


def _steps(text: Column, pattern: str, kind: str, loose: bool) -> Column:
    """array<struct<kind, loose, gap, n, m, tail>> of the leftmost matches: how many code points lie between a match and
    the one before, its length, itself, and the last of what lies before it. Places are sums of gaps and lengths."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(between, 1, F.greatest(F.lit(0), F.size(between) - 1))
    return F.zip_with(
        found, gaps, lambda m, b: F.struct(F.lit(kind).alias("kind"), F.lit(loose).alias("loose"), F.length(b).alias("gap"), F.length(m).alias("n"), m.alias("m"), F.substring(b, F.greatest(F.length(b) - 23, F.lit(1)), F.lit(24)).alias("tail"))
    )


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))
    value = lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 0, 2 * value(i) - F.when(value(i) > 4, 9).otherwise(0)).otherwise(value(i))
    return F.aggregate(places, F.lit(0), lambda acc, i: acc + doubled(i)) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    """The base check of a match."""
    if kind == "ip":
        return m.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        n = F.length(_digits(m))
        return (n >= 16) & (n <= 19) & F.when((n >= 16) & (n <= 19), luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def candidates(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row_key, kind, s, e, m, base, before): distinct base spans and proposals; null texts have none.

    A text is searched for a pattern only if it holds what the pattern cannot do without.
    """
    t = F.col("t")
    has = lambda *xs: F.greatest(*(F.contains(t, F.lit(x)) for x in xs)) if len(xs) > 1 else F.contains(t, F.lit(xs[0]))
    searches = [
        ("email", True, EMAIL, has("@")),
        ("ip", True, IP, t.rlike(r"[0-9]\.[0-9]")),
        ("card", True, CARD, t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")),
        ("phone", True, PHONE, t.rlike(r"\+[0-9]")),
        ("email", False, LOOSE_EMAIL, t.rlike(r"[\[(]at[\])]")),
        ("phone", False, LOOSE_PHONE, t.rlike(r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}")),
        ("secret", False, SECRET, t.rlike(r"[A-Za-z0-9_-]{24}")),
    ]
    none = F.array().cast("array<struct<kind:string,loose:boolean,gap:int,n:int,m:string,tail:string>>")
    spans = [F.when(need, _steps(t, p, kind, not base)).otherwise(none) for kind, base, p, need in searches]
    any_digit = t.rlike(r"[0-9@\[(]|[A-Za-z0-9_-]{24}")
    d = docs.select(row_key(doc_id, text).alias("row_key"), F.col(text).alias("t")).where(any_digit)
    found = d.select("row_key", F.monotonically_increasing_id().alias("_row"), F.concat(*spans).alias("spans")).where(F.size("spans") > 0)
    found = found.select("row_key", "_row", F.posexplode("spans").alias("i", "x")).select("row_key", "_row", "i", "x.*")
    # a text's matches of one pattern, from left to right
    order = Window.partitionBy("_row", "row_key", "kind", "loose").orderBy("i")
    found = found.withColumn("e", F.sum(F.col("gap") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).withColumn("s", F.col("e") - F.col("n"))
    found = found.withColumn("before", F.when(F.col("gap") < 24, F.concat(F.coalesce(F.lag("m").over(order), F.lit("")), "tail")).otherwise(F.col("tail")))
    found = found.select("row_key", "kind", "loose", "s", "e", "m", F.expr("right(before, 24)").alias("before")).distinct()
    ok = F.lit(False)
    for kind in KINDS[:4]:
        ok = F.when(F.col("kind") == kind, _passes(kind, F.col("m"))).otherwise(ok)
    found = found.withColumn("base", ~F.col("loose") & ok)
    n = F.length(_digits(F.col("m")))
    # numbers of 13 to 15 digits, too short for a base card, are proposals; other failed matches are dropped for good
    mixed = F.col("m").rlike("[0-9]") & F.col("m").rlike("[A-Za-z]")
    again = (F.col("loose") & ((F.col("kind") != "secret") | mixed)) | ((F.col("kind") == "card") & n.between(13, 15) & ~ok)
    return found.where(F.col("base") | again).select("row_key", "kind", "s", "e", "m", "base", "before")


def _by_kind(patterns: dict[str, str], c: Column) -> Column:
    out = F.lit(False)
    for kind, p in patterns.items():
        out = F.when(F.col("kind") == kind, c.rlike(p)).otherwise(out)
    return out


def labelled(spans: DataFrame) -> DataFrame:
    """Adds the votes v1 (shape), v2 (gazetteer), v3 (context): 1 for, 0 against, -1 none; and the features f0, f1, ..."""
    m, n = F.col("m"), F.length("m")
    digits = F.length(_digits(m))
    shape = F.when(F.col("base"), 1).when(F.col("kind").isin("card"), F.when(luhn(_digits(m)), 1).otherwise(0)).when(F.col("kind") == "secret", F.when(m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & (n % 8 == 0), 1).otherwise(-1)).otherwise(-1)
    known = _by_kind(AFFIX, m)
    near = _by_kind(CONTEXT, F.col("before"))
    # what the classifier sees is not what the labelers vote on
    kinds_of = F.size(F.array_distinct(F.split(m, "")))
    features = [n >= 12, n >= 20, n >= 32, n >= 40, 2 * digits >= n, digits == n, m.rlike("[^A-Za-z0-9]"), m.rlike("[A-Z]") & m.rlike("[a-z]"), m.rlike("[g-zG-Z]"), kinds_of >= 10, F.col("before").rlike(r"[\"'=:(\[]\s?$")]
    out = spans.withColumns({"v1": shape, "v2": F.when(known, 1).otherwise(F.when(F.col("kind") == "secret", -1).otherwise(0)), "v3": F.when(near, 1).otherwise(-1)})
    return out.withColumns({f"f{i}": f.cast("int") for i, f in enumerate(features)})


FEATURES = [f"f{i}" for i in range(11)]


def reliabilities(counts: list[tuple], rounds: int = 50) -> tuple[dict, dict]:
    """Expectation-maximisation on (kind, v1, v2, v3, count): ({kind: prior}, {kind: [(P(for | true), P(for | false))] by
    labeler}). A kind's rates lean on those of all kinds as if on 20 more spans."""
    kinds = sorted({k for k, *_ in counts})
    prior = dict.fromkeys(kinds, 0.5)
    rates = {k: [(0.8, 0.2)] * 3 for k in kinds}
    for _ in range(rounds):
        sums = {k: [[0.0, 0.0, 0.0, 0.0] for _ in range(3)] for k in kinds}
        per: dict[str, list[float]] = {k: [1.0, 2.0] for k in kinds}
        for kind, *votes, n in counts:
            p = posterior(prior[kind], rates[kind], votes)
            per[kind][0] += n * p
            per[kind][1] += n
            for s, v in zip(sums[kind], votes):
                if v >= 0:
                    s[0] += n * p * v
                    s[1] += n * p
                    s[2] += n * (1 - p) * v
                    s[3] += n * (1 - p)
        prior = {k: min(0.98, max(0.02, a / b)) for k, (a, b) in per.items()}
        pooled = [[sum(sums[k][i][j] for k in kinds) for j in range(4)] for i in range(3)]
        pooled = [((a + 4) / (b + 5), (c + 1) / (d + 5)) for a, b, c, d in pooled]
        lean = lambda x, n, toward: min(0.98, max(0.02, (x + 20 * toward) / (n + 20)))
        rates = {k: [(lean(a, b, yes), lean(c, d, no)) for (a, b, c, d), (yes, no) in zip(sums[k], pooled)] for k in kinds}
    return prior, rates


def posterior(prior: float, rates: list, votes: list[int]) -> float:
    yes, no = math.log(prior), math.log(1 - prior)
    for (a, b), v in zip(rates, votes):
        if v >= 0:
            yes += math.log(a if v else 1 - a)
            no += math.log(b if v else 1 - b)
    return 1 / (1 + math.exp(min(700.0, no - yes)))


def train(rows: list[tuple], kinds: tuple[str, ...] = KINDS, rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
    """Logistic weights (bias, kinds, features) from (kind, features, mean posterior, count)."""
    total = sum(n for *_, n in rows) or 1
    x = [([1.0, *(float(k == kind) for k in kinds), *map(float, f)], p, n / total) for kind, f, p, n in rows]
    w = [0.0] * (1 + len(kinds) + len(FEATURES))
    for _ in range(rounds):
        g = [decay * a for a in w]
        for v, p, n in x:
            e = n * (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, v)))))) - p)
            for i, b in enumerate(v):
                g[i] += e * b
        w = [a - rate * b * 4 for a, b in zip(w, g)]
    return w


def find(docs: DataFrame, accept: float = 0.9, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_key, kind, start, end, base, probability): the base spans and the accepted proposals, distinct.

    Places are code points, end exclusive. `row_key` is common.row_key(doc_id, text). Null and empty texts have no spans.
    """
    spans = stored(labelled(candidates(docs, doc_id, text)), "spans")
    votes = [tuple(r) for r in spans.groupBy("kind", "v1", "v2", "v3").count().collect()]  # at most 27 rows a kind
    prior, rates = reliabilities(sorted(votes))
    patterns = spans.groupBy("kind", *FEATURES, "v1", "v2", "v3").count().collect()  # 2**11 x 27 rows a kind at most
    seen: dict = {}
    for r in patterns:
        p = posterior(prior[r["kind"]], rates[r["kind"]], [r["v1"], r["v2"], r["v3"]])
        a = seen.setdefault((r["kind"], tuple(r[f] for f in FEATURES)), [0.0, 0])
        a[0] += p * r["count"]
        a[1] += r["count"]
    w = train(sorted((k, f, s / n, n) for (k, f), (s, n) in seen.items()))
    score = F.lit(w[0])
    for k, a in zip(KINDS, w[1:]):
        score = score + F.when(F.col("kind") == k, F.lit(a)).otherwise(F.lit(0.0))
    for f, a in zip(FEATURES, w[1 + len(KINDS) :]):
        score = score + F.col(f) * F.lit(a)
    chosen = spans.withColumn("probability", 1 / (1 + F.exp(-score))).where(F.col("base") | (F.col("probability") >= accept))
    return chosen.select("row_key", "kind", F.col("s").alias("start"), F.col("e").alias("end"), "base", "probability")


def per_document(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per document: doc_id, row_key, spans: array of (rank of kind, kind, start, end, base), by kind and start.

    A proposal that overlaps a base span of its text, or a proposal that starts earlier, is dropped. Repeated rows get a
    row each; null and empty texts an empty array; null ids are kept.
    """
    found = find(docs, doc_id=doc_id, text=text, **how)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    # a text's spans are fewer than its characters; each looks at what has come so far and at the next base span
    order = Window.partitionBy("row_key").orderBy("start", ~F.col("base"), "rank", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # the same order from the end: a frame that grows row by row, unlike one that shrinks
    back = Window.partitionBy("row_key").orderBy(F.desc("start"), "base", F.desc("rank"), F.desc("end"))
    next_base = F.min(F.when(F.col("base"), F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    free = F.coalesce(reached <= F.col("start"), F.lit(True)) & F.coalesce(next_base >= F.col("end"), F.lit(True))
    found = found.withColumn("rank", rank).withColumn("free", F.col("base") | free).where("free")
    grouped = found.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("rank", "start", "end", "kind", "base"))).alias("spans"))
    base = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"))
    return base.join(grouped, "row_key", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<rank:bigint,start:int,end:int,kind:string,base:boolean>>")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
