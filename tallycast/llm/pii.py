"""Personal data: fixed patterns as seeds, and bootstrapped contextual patterns that find identifiers of unknown form.

Built of DataFrame functions alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.functions.names import unused

from . import sieve, store

#: Fixed patterns of the base kinds, in their order. Possessive and anchored to the start of a run, so a match is the same
#: but a long run without one is read once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "id"]

#: What could be an identifier: a run of letters, digits and joining signs with a digit in it, between letters or digits.
_SIGNS = r"A-Za-z0-9_=+/@%:.\-"
CANDIDATE = rf"(?<![{_SIGNS}])(?=[{_SIGNS}]*[0-9])[A-Za-z0-9][{_SIGNS}]*[A-Za-z0-9]"


#: Words before a token that name it a secret: seeds of the contexts, as the fixed patterns are of the instances.
LABEL = r"(?:token|secret|password|passwd|pwd|passphrase|credentials?|(?:api|access|auth|secret|private)[_\x20-]?key)"
_GIVEN = r"""["'`]?\x20?(?::=|=>|[=:])\x20?"""

#: Keys whose issuers give them a form of their own, which needs no context.
ISSUED = r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|[sr]k_live_[A-Za-z0-9]{16,})$"


@dataclass(frozen=True)
class Bootstrap:
    """How far contexts are trusted."""

    #: A pattern's confidence is the number of its identifiers over that of its instances plus this.
    doubt: float = 2.0
    #: A pattern tells something if its share of identifiers is so many standard errors above that of the seeds elsewhere.
    telling: float = 4.0
    #: A context vouches for a token if it tells something and its confidence is at least this.
    vouch: float = 0.5
    #: Confidence of a label like ``token =``.
    label: float = 0.9
    #: A pattern needs so many different instances.
    support: int = 3
    #: Instances that score at least this are identifiers.
    accept: float = 0.8
    shortest: int = 8


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda have, i: have + part(i)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        small = lambda p: F.coalesce(F.when(F.ltrim(p, F.lit("0")) == "", 0).otherwise(F.ltrim(p, F.lit("0")).try_cast("int")) <= 255, F.lit(False))
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _failed(kind: str) -> Column:
    """The matches that have the whole form of their kind, but fail the check."""
    whole = lambda match: F.length(F.regexp_replace(match, "[^0-9]", "")).between(13, 19) if kind == "card" else F.lit(True)
    return F.filter(kind, lambda x: whole(x["match"]) & ~_valid(kind, x["match"]))


#: Matches are placed in blocks, as an array that grows by one is copied each time.
BLOCK = 256
FOUND = "array<struct<start:int,end:int,match:string,gap:string,after:string>>"


def located(text: Column, pattern: str) -> Column:
    """(gap, match) of all leftmost matches that don't overlap, each with the text between it and the one before; the last is the text
    behind all matches, without a match."""
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return F.arrays_zip(between.alias("gap"), matches.alias("match"))


def placed(pieces: str) -> Column:
    """The matches of :func:`located`, a column: (start, end, match, gap, after), the ends in code points and exclusive."""
    n = F.size(pieces) - 1
    empty = F.array().cast(FOUND)

    def within(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), empty.alias("found"))
        return F.aggregate(F.slice(pieces, block * BLOCK + 1, F.least(F.lit(BLOCK), n - block * BLOCK)), start, step)

    def step(have: Column, piece: Column) -> Column:
        start = have["at"] + F.length(piece["gap"])
        end = start + F.length(piece["match"])
        span = F.struct(start.alias("start"), end.alias("end"), piece["match"].alias("match"), piece["gap"].alias("gap"), F.lit(None).cast("string").alias("after"))
        return F.struct(end.alias("at"), F.concat(have["found"], F.array(span)).alias("found"))

    def shift(have: Column, block: Column) -> Column:
        moved = F.transform(block["found"], lambda x: F.struct((x["start"] + have["at"]).alias("start"), (x["end"] + have["at"]).alias("end"), x["match"].alias("match"), x["gap"].alias("gap"), x["after"].alias("after")))
        return F.struct((have["at"] + block["at"]).alias("at"), F.concat(have["blocks"], F.array(moved)).alias("blocks"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), within)
    whole = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{FOUND}>").alias("blocks")), shift, lambda have: F.flatten(have["blocks"]))
    with_after = F.transform(whole, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"), x["gap"].alias("gap"), F.get(pieces, i + 1)["gap"].alias("after")))
    return F.when(n > 0, with_after).otherwise(empty)


def _base_spans(kind: str, place: int) -> Column:
    valid = F.filter(kind, lambda x: _valid(kind, x["match"]))
    return F.transform(valid, lambda x: F.struct(F.lit(place).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def _count(found: str, place: int) -> Column:
    return F.size(F.filter(found, lambda x: x["kind"] == place)).cast("long")


def scanned(docs: DataFrame, bootstrap: Bootstrap = Bootstrap()) -> DataFrame:
    """(doc_id, text_hash, base, candidates) for each row: base spans as (kind, start, end), candidates with their contexts.

    The only step that reads texts. A text without a digit or an ``@`` holds neither and is passed over by one scan.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digit = text.rlike("[0-9]")
    none = F.array().cast("array<struct<gap:string,match:string>>")
    found = docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"),
        *[F.when(text.contains("@") if kind == "email" else digit, located(text, pattern)).otherwise(none).alias(kind) for kind, pattern in PATTERNS.items()],
        F.when(digit, located(text, CANDIDATE)).otherwise(none).alias("tokens"),
    )
    found = found.select("doc_id", "text_hash", *[placed(kind).alias(kind) for kind in [*PATTERNS, "tokens"]])
    kinds = [_base_spans(kind, i) for i, kind in enumerate(PATTERNS)]
    long_enough = F.filter("tokens", lambda x: (F.length(x["match"]) >= bootstrap.shortest) & x["match"].rlike("[0-9]"))
    failed = [_failed(kind) for kind in ("ip", "card")]
    with_base = found.select("doc_id", "text_hash", F.concat(*kinds).alias("base"), F.concat(*failed).alias("failed"), long_enough.alias("tokens"))

    def context(x: Column) -> Column:
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("token"),
            F.lower(F.regexp_extract(x["gap"], r"([^\x20\x09-\x0D]{1,40})[\x20\x09-\x0D]*$", 1)).alias("left"),
            F.lower(F.regexp_extract(x["after"], r"^[^\x20\x09-\x0D]*[\x20\x09-\x0D]+([^\x20\x09-\x0D]{1,40})", 1)).alias("right"),
            F.regexp_replace(F.regexp_extract(F.lower(F.substring(x["gap"], -128, 128)), r"((?:[^\x20\x09-\x0D]{1,40}[\x20\x09-\x0D]+){0,2}[^\x20\x09-\x0D]{1,40})[\x20\x09-\x0D]*$", 1), r"[\x20\x09-\x0D]+", " ").alias("phrase"),
            F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])).alias("known"),
            F.exists("failed", lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"])).alias("failed"),
        )

    return with_base.select("doc_id", "text_hash", "base", F.transform("tokens", context).alias("candidates"))


def patterns_of(token: Column, left: Column, phrase: Column, right: Column) -> Column:
    """The lexical patterns an occurrence is an instance of: a label, word before, up to three words before, word after, first signs, and
    kinds of signs with length."""
    kinds = F.concat(*[F.when(token.rlike(signs), mark).otherwise("") for signs, mark in (("[a-z]", "a"), ("[A-Z]", "A"), ("[0-9]", "9"), ("@", "@"), ("=", "="), ("[+/:%_.-]", "."))])
    shape = F.concat(F.lit("shape "), kinds, F.lit(" "), F.floor(F.log2(F.length(token)) * 2).cast("string"))
    head = F.concat(F.lit("head "), F.regexp_extract(token, "^([A-Za-z]{0,4})", 1))
    told = phrase.rlike(rf"""(?:^|[^a-z]){LABEL}{_GIVEN}["'`]?$""") | F.lower(token).rlike(rf"^(?:[a-z_-]*[^a-z])?{LABEL}{_GIVEN}") | token.rlike(ISSUED)
    several = F.when(phrase.contains(" "), F.concat(F.lit("phrase "), phrase))
    return F.array_compact(F.array(F.when(told, F.lit("label")), F.concat(F.lit("left "), left), several, F.concat(F.lit("right "), right), head, shape))


def identifiers(scan: DataFrame, bootstrap: Bootstrap = Bootstrap()) -> DataFrame:
    """(token, score) of unseen identifiers: the graph of patterns and instances is scored from the seeds on.

    In each round a pattern's confidence is the share of seeds and of identifiers found so far in its distinct instances (with doubt added), and
    a token scores one minus the product of its telling patterns' doubts, if a label or a context vouches for it: how it looks supports
    it, but is no reason alone. What has the form of a base kind and fails its check counts against its patterns, and only a label
    outweighs that. What was found stays, and the rounds end when one finds no more.
    A frequent word or token is one hot pattern or instance: its edges are summed partially, and joined back by a join that Spark can split.
    """
    each = scan.select(F.explode("candidates").alias("c")).select("c.*")
    edges = each.select("token", "known", "failed", F.explode(patterns_of(F.col("token"), F.col("left"), F.col("phrase"), F.col("right"))).alias("pattern"))
    edges = store.written(edges.groupBy("token", "pattern").agg(F.max("known").alias("known"), F.max("failed").alias("failed")), "pii-edges")
    tokens = edges.groupBy("token").agg(F.max("known").alias("seed"), (F.max("failed") & ~F.max(F.col("pattern") == "label")).alias("failed"))
    tokens = store.written(tokens, "pii-tokens")
    every = tokens.agg(F.count("*").alias("n"), F.count_if("seed").alias("k")).first()
    n, k = F.col("n"), F.col("k")
    edges = edges.select("token", "pattern").join(tokens, "token")
    patterns = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.count_if("seed").alias("k")).where(n >= bootstrap.support)
    patterns = store.written(patterns, "pii-patterns")
    # Only these can still be found; a failed check stands.
    edges = store.written(edges.where(~F.col("seed") & ~F.col("failed")).select("token", "pattern"), "pii-open")
    label, context = F.col("pattern") == "label", F.substring_index("pattern", " ", 1).isin("left", "phrase", "right")
    have, found = 0, edges.select("token", F.lit(0.0).alias("score")).limit(0)
    while True:
        more = edges.join(found.select("token"), "token").groupBy("pattern").agg(F.count("*").alias("more"))
        s = k + F.coalesce("more", F.lit(0))
        elsewhere = (every["k"] + have - s + 1) / (every["n"] - n + 2)
        sure = patterns.join(more, "pattern", "left").where(~label).select("pattern", "n", s.alias("s"), elsewhere.alias("p"))
        sure = sure.where((F.col("s") - n * F.col("p")) >= bootstrap.telling * F.sqrt(n * F.col("p") * (1 - F.col("p"))))
        sure = sure.select("pattern", F.least(F.col("s") / (n + bootstrap.doubt), F.lit(0.999)).alias("confidence"))
        judged = edges.join(sure, "pattern", "left").withColumn("confidence", F.when(label, F.lit(bootstrap.label)).otherwise(F.col("confidence")))
        judged = judged.where("confidence is not null").groupBy("token").agg(
            (1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"), F.max(label | (context & (F.col("confidence") >= bootstrap.vouch))).alias("vouched")
        )
        new = judged.where(F.col("vouched") & (F.col("score") >= bootstrap.accept)).select("token", "score").join(found, "token", "left_anti")
        found = store.written(found.unionAll(new), "pii-round")
        before, have = have, found.count()
        if have == before:
            return found


def spans(docs: DataFrame, bootstrap: Bootstrap = Bootstrap()) -> DataFrame:
    """(doc_id, text_hash, base, all) for each row of ``docs``: arrays of (kind, start, end), ``kind`` being the place in ``KINDS``.

    Null and empty texts have no spans. Rows that repeat a doc_id are read on their own.
    """
    scan = store.written(scanned(docs, bootstrap), "pii-scan")
    found = store.written(identifiers(scan, bootstrap), "pii-found")
    each = scan.select("doc_id", "text_hash", F.explode("candidates").alias("c")).where(~F.col("c.known")).select("doc_id", "text_hash", "c.token", "c.start", "c.end").distinct()
    span = F.struct(F.lit(len(PATTERNS)).alias("kind"), "start", "end")
    more = each.join(found, "token").groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(span)).alias("more"))
    more = more.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "more")
    out = scan.join(more, scan["doc_id"].eqNullSafe(more["_id"]) & (scan["text_hash"] == more["_hash"]), "left")
    return out.select("doc_id", "text_hash", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more")).alias("all"))


def listed(found: Column) -> Column:
    """The spans as text: kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, bootstrap: Bootstrap = Bootstrap()) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id), a row for each row of ``docs``."""
    found = spans(docs, bootstrap)
    counts = [_count("base", i).alias(f"n_{kind}") for i, kind in enumerate(PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"), (F.size("all") - F.size("base")).cast("long").alias("n_id"))


def masked(docs: DataFrame, bootstrap: Bootstrap = Bootstrap()) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in angle brackets; overlapping spans by the first one's.

    Texts that surely hold no span don't move (see :mod:`sieve`).
    """
    id_, hash_, all_ = unused(docs.columns, "id", "hash", "all")
    found = spans(docs, bootstrap).where(F.size("all") > 0).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("all").alias(all_)).dropDuplicates([id_, hash_])
    found = store.written(found, "pii-spans")
    clean, docs = sieve.parted(docs, [docs["doc_id"], F.xxhash64(docs["text"])], found.select(id_, hash_))
    same = docs["doc_id"].eqNullSafe(found[id_]) & (F.xxhash64(docs["text"]) == found[hash_])
    name = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    by_place = F.array_sort(F.transform(all_, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(have: Column, span: Column) -> Column:
        piece = F.array(F.substring("text", have["at"] + 1, span["start"] - have["at"]), F.get(name, span["kind"]))
        return F.when(span["start"] < have["at"], F.struct(F.greatest(have["at"], span["end"]).alias("at"), have["out"].alias("out"))).otherwise(
            F.struct(span["end"].alias("at"), F.concat(have["out"], piece).alias("out"))
        )

    whole = F.aggregate(by_place, state, step, lambda have: F.concat(F.array_join(have["out"], ""), F.substring("text", have["at"] + 1, F.length("text"))))
    columns = [F.when(F.col(all_).isNull(), F.col("text")).otherwise(whole).alias("text") if c == "text" else docs[c] for c in docs.columns]
    return clean.union(docs.join(found, same, "left").select(columns))
