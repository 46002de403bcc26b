"""Secret scans.

Fixed patterns find assignments, access keys and long hex runs. Two first-order
character Markov models, one of random strings and one of ordinary identifiers,
both trained from labelled samples, then judge what the patterns leave of every
long token: it is a secret if the log-likelihood ratio per character reaches the
threshold. What is none as a whole is judged again in pieces, between / and = and
then between + _ and - too.

DataFrame functions only. A match's place comes from the lengths of the pieces
between matches, so it costs two passes of the pattern over texts that have one.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, table_literal

#: In the order in which spans that begin together are listed.
KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS, _HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
#: Runs of token characters of this length or more, and pieces of runs, are judged by the models whatever they hold.
MIN_TOKEN = 20
#: From this length on they are judged if they hold a letter and a digit: so few letters alone do not tell a key from a word.
MIN_MIXED = 12
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Symbols: the alphabet from 1, 0 for the start of a token.
K = len(ALPHABET) + 1
#: Nats per character by which the random model must win. Held-out samples of the two classes lie on either side of it (see `measured`).
THRESHOLD = 0.6
#: Labelled samples: this many strings of each class, made by rule.
SAMPLES = 3000
#: Stems of the ordinary identifiers of the default samples.
STEMS = (
    "get set is has make build load save read write open close user name file path index value count list table column row key item node edge graph "
    "config option default handler manager service client server request response message error result status state event data model view page "
    "document text token word line string number array object type class function method parameter argument return update delete insert select "
    "create remove find search filter sort merge split join parse format encode decode transform process execute schedule worker thread queue "
    "international communication development organisation information responsibility understanding administration implementation representation "
    "entwicklung verantwortung gesellschaft wissenschaft geschwindigkeit freundschaft lichkeit heit keit schaft ung ver ent be ge ein zu ich sch der die das "
    "gouvernement developpement connaissance environnement quelques ment tion eau aux elle ouvre entre pour avec dans "
    "desarrollo conocimiento gobierno ciones mente idad amiento para como entre sobre desde the and that with from this ing ion ent ere ther tion"
).split()


def default_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(token, secret): digests in base64 and hex against identifiers and paths composed of STEMS and runs of one character."""
    ids = spark.range(n, numPartitions=1)
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    b64 = F.substring(F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9+/]", ""), 1, 40)
    rand = ids.select(F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 4 == 1, F.upper(F.substring(digest, 1, 40))).otherwise(b64).alias("token"), F.lit(True).alias("secret"))
    stems = F.split(F.lit(" ".join(STEMS)), " ")

    def stem(i: int) -> Column:
        return F.element_at(stems, (F.conv(F.substring(digest, 1 + 4 * i, 4), 16, 10).cast("long") % len(STEMS) + 1).cast("int"))

    three = [stem(i) for i in range(4)]
    plain = ids.select(
        F.when(F.col("id") % 6 == 5, F.repeat(F.substr(F.lit(ALPHABET), (F.expr("id div 6") % len(ALPHABET) + 1).cast("int"), F.lit(1)), F.lit(24)))  # rulers and filler
        .when(F.col("id") % 7 == 3, F.concat_ws("/", *three))
        .when(F.col("id") % 5 == 0, F.concat_ws("_", *three))
        .when(F.col("id") % 5 == 1, F.concat(three[0], *[F.initcap(s) for s in three[1:]]))
        .when(F.col("id") % 5 == 2, F.concat_ws("-", *three[:3], (F.col("id") % 100).cast("string")))
        .when(F.col("id") % 5 == 3, F.upper(F.concat_ws("_", *three[:3])))
        .otherwise(F.concat(*three))
        .alias("token"),
        F.lit(False).alias("secret"),
    )
    return rand.unionByName(plain)


def codes(token: Column) -> Column:
    """Symbols of a token."""
    return F.transform(F.filter(F.split(token, ""), lambda c: c != F.lit("")), lambda c: F.instr(F.lit(ALPHABET), c))


def pairs(token: Column) -> Column:
    """Index of each (previous symbol, symbol), the first with the start symbol."""
    s = codes(token)
    return F.zip_with(F.slice(F.concat(F.array(F.lit(0)), s), F.lit(1), F.size(s)), s, lambda y, z: y * K + z)


def ratio_table(samples: DataFrame) -> DataFrame:
    """One row with one array of K * K log ratios, ln P(symbol | previous) under the random model less the ordinary one, each smoothed by its unigrams.

    Its size is fixed, whatever the samples.
    """
    seen = samples.filter(F.col("token").isNotNull()).select("secret", F.explode(pairs(F.col("token"))).alias("k"))
    counts = seen.groupBy("k").agg(F.sum(F.col("secret").cast("double")).alias("r"), F.sum((~F.col("secret")).cast("double")).alias("o"))
    grid = samples.sparkSession.range(K * K, numPartitions=1).select(F.col("id").alias("k"), F.floor(F.col("id") / K).alias("a"), (F.col("id") % K).alias("b"))
    cells = grid.join(counts, "k", "left").fillna(0.0, ["r", "o"])
    uni = cells.groupBy("b").agg(F.sum("r").alias("rb"), F.sum("o").alias("ob"))
    ctx = cells.groupBy("a").agg(F.sum("r").alias("ra"), F.sum("o").alias("oa"))
    tot = cells.agg(F.sum("r").alias("rn"), F.sum("o").alias("on"))
    cells = cells.join(uni, "b").join(ctx, "a")
    rn, on = tot.select("rn").scalar(), tot.select("on").scalar()

    def p(n: str, a: str, b: str, total: Column) -> Column:
        return (F.col(n) + 4.0 * (F.col(b) + 0.5) / (total + 0.5 * K)) / (F.col(a) + 4.0)

    cells = cells.select("k", F.log(p("r", "ra", "rb", rn) / p("o", "oa", "ob", on)).alias("v"))
    return cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("ratios"))


def measured(samples: DataFrame, threshold: float = THRESHOLD, share: float = 0.2, seed: int = 7) -> DataFrame:
    """One row (secrets, plain, precision, recall) of the models at a threshold on held-out samples, a drawn share; the others are learned from."""
    drawn = samples.filter("token is not null and secret is not null and token != ''").withColumn("_draw", F.rand(seed))
    ratios = table_literal(ratio_table(drawn.filter(F.col("_draw") >= share)))
    judged = drawn.filter(F.col("_draw") < share).select("secret", (score_of(F.col("token"), ratios) >= threshold).alias("hit"))
    both = F.count_if(F.col("secret") & F.col("hit"))
    return judged.agg(F.count_if("secret").alias("secrets"), F.count_if(~F.col("secret")).alias("plain"), (both / F.nullif(F.count_if("hit"), F.lit(0))).alias("precision"), (both / F.nullif(F.count_if("secret"), F.lit(0))).alias("recall"))


def score_of(token: Column, ratios: Column) -> Column:
    """Log-likelihood ratio per character."""
    return F.aggregate(pairs(token), F.lit(0.0), lambda s, k: s + F.element_at(ratios, (k + 1).cast("int"))) / F.length(token)


_SPANS = "array<struct<start:long,stop:long,match:string>>"


def _let(value: Column, body) -> Column:
    """body(value), the value being worked out once: what stands in a lambda is evaluated again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(items: Column) -> Column:
    """The items in consecutive blocks of about the root of their number, so that steps that are quadratic in a block cost little more than a pass over the items."""
    def cut(own: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(own))), F.lit(1)).cast("int")
        return _let(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / w).cast("int")), lambda i: F.slice(own, i * w + 1, w)))

    return _let(items, lambda own: F.when(F.size(own) > 0, cut(own)).otherwise(F.slice(F.array(own), 1, 0)))


def _before(sizes: Column, step, zero: Column) -> Column:
    """For each block what `step` makes of all blocks before it."""
    return F.transform(F.sequence(F.lit(0), F.size(sizes) - 1), lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), zero, step))


def _found(text: Column, pattern: str) -> Column:
    """array<struct<start,stop,match>> of the leftmost non-overlapping matches, in code points."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
    zipped = F.filter(F.arrays_zip(hits.alias("hit"), gaps.alias("gap")), lambda h: h["hit"].isNotNull())

    def step(acc, h):
        at = acc["at"] + h["gap"]
        end = at + F.length(h["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("start"), end.alias("stop"), h["hit"].alias("match")))).alias("out"))

    def placed(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(_SPANS).alias("out")), step, lambda acc: acc["out"])

    def whole(blocks: Column) -> Column:
        long = lambda x: x.cast("long")
        sizes = F.transform(blocks, lambda b: F.aggregate(b, long(F.lit(0)), lambda n, h: n + h["gap"] + F.length(h["hit"])))
        return F.flatten(F.zip_with(blocks, _let(sizes, lambda n: _before(n, lambda x, y: x + y, long(F.lit(0)))), placed))

    return F.when(text.rlike(pattern), _let(_blocks(zipped), whole)).otherwise(F.array().cast(_SPANS))


def _left(run: Column, spans: Column) -> Column:
    """array<struct<start,stop,match>>: what the spans leave of a run, in order."""
    over = F.filter(spans, lambda b: (b["start"] < run["stop"]) & (run["start"] < b["stop"]))

    def cut(at: Column, stop: Column) -> Column:
        match = F.substr(run["match"], (at - run["start"] + 1).cast("int"), (stop - at).cast("int"))
        return F.when(at < stop, F.array(F.struct(at.alias("start"), stop.alias("stop"), match.alias("match")))).otherwise(F.array().cast(_SPANS))

    start = F.struct(run["start"].alias("at"), F.array().cast(_SPANS).alias("out"))
    step = lambda acc, b: F.struct(F.greatest(acc["at"], b["stop"]).alias("at"), F.concat(acc["out"], cut(acc["at"], b["start"])).alias("out"))
    return F.aggregate(F.array_sort(over), start, step, lambda acc: F.concat(acc["out"], cut(acc["at"], run["stop"])))


def _all_left(runs: Column, spans: Column) -> Column:
    """What the spans leave of all runs, which are in order: a block of runs is held against the spans that reach into it."""

    def block(own: Column) -> Column:
        first, last = F.element_at(own, 1)["start"], F.element_at(own, -1)["stop"]
        near = F.filter(spans, lambda b: (b["start"] < last) & (first < b["stop"]))
        return _let(near, lambda n: F.flatten(F.transform(own, lambda t: F.when(F.size(n) > 0, _left(t, n)).otherwise(F.array(t)))))

    return F.flatten(F.transform(_blocks(runs), block))


def _pieces(token: Column, pattern: str) -> Column:
    """The matches of a pattern in a token, placed in the text."""
    return F.transform(_found(token["match"], pattern), lambda x: F.struct((token["start"] + x["start"]).alias("start"), (token["start"] + x["stop"]).alias("stop"), x["match"].alias("match")))


def _tagged(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["stop"].alias("stop")))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


#: Columns that a scan adds, and those that come and go.
OWN = ("_base", "_spans", "_tokens", "_models", "_text")


def scan(docs: DataFrame, text_col: str = "text", samples: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Every row with `_base` and `_spans`: array<struct<start,kind,stop>>, kind an index of KINDS.

    `_base` has the patterns' spans, `_spans` those and the models'. A null or
    empty text has none. With samples of one class only, nothing is added but
    what that class's smoothing yields. Rows are kept as they are, repeated ones
    too, and an empty table gives an empty result. Very long texts are scanned
    whole, in time that grows with the number of matches to the power 1.5 at most.
    Columns with the names of added ones are replaced, others pass through.
    """
    spark = docs.sparkSession
    docs = docs.drop(*OWN)
    ratios = table_literal(ratio_table(default_samples(spark) if samples is None else samples))
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign = F.filter(_found(text, _ASSIGN), lambda x: F.length(F.regexp_extract(x["match"], _ASSIGN, 2)) >= 12)
    out = docs.withColumn("_base", F.concat(_tagged(assign, "assign"), _tagged(_found(text, _ACCESS), "access"), _tagged(_found(text, _HEX), "hex")))
    tokens = _found(text, rf"[A-Za-z0-9+/_=-]{{{MIN_MIXED},}}")
    base = F.col("_base")
    score = lambda t: score_of(t["match"], ratios)
    long = lambda t: (F.length(t["match"]) >= MIN_TOKEN) | ((F.length(t["match"]) >= MIN_MIXED) & t["match"].rlike("[0-9]") & t["match"].rlike("[A-Za-z]"))
    judged = lambda found: F.transform(found, lambda t: t.withField("hit", F.when(long(t), score(t) >= F.lit(threshold)).otherwise(False)))
    out = out.withColumn("_tokens", _all_left(tokens, base)).withColumn("_models", F.array().cast("array<struct<start:long,kind:int,stop:long>>"))
    for pattern in (None, "[^/=]+", "[^/=+_-]+"):
        if pattern:
            rest = F.filter("_tokens", lambda t: ~t["hit"] & t["match"].rlike("[/=+_-]"))
            out = out.withColumn("_tokens", F.flatten(F.transform(rest, lambda t: _pieces(t, pattern))))
        out = out.withColumn("_tokens", judged(F.col("_tokens")))
        out = out.withColumn("_models", F.concat("_models", _tagged(F.filter("_tokens", lambda t: t["hit"]), "markov")))
    return out.withColumn("_spans", F.concat(base, "_models")).drop("_tokens", "_models")


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[secret]", **kw) -> DataFrame:
    """The documents with every span of their texts replaced by a mask; overlapping spans become one mask. Null texts stay null; what `scan` says of other cases holds."""
    docs, back = aside(docs, *OWN)
    text_col = {old: new for new, old in back.items()}.get(text_col, text_col)
    cols = docs.columns
    found = scan(docs, text_col, **kw)
    text, long = F.col(text_col), F.lit(0).cast("long")

    def part(own: Column, begin: Column) -> Column:
        """A block's stretch of the text, from where the blocks before end, masked."""
        stretch = F.substr(text, (begin + 1).cast("int"), (F.array_max(F.transform(own, lambda s: s["stop"])) - begin).cast("int"))

        def masked(piece: Column) -> Column:
            def step(acc, s):
                gap = F.concat(F.substr(piece, (acc["at"] - begin + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask))
                return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], F.when(s["start"] < acc["at"], F.lit("")).otherwise(gap)).alias("out"))

            return F.aggregate(own, F.struct(begin.alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

        return _let(stretch, masked)

    def whole(blocks: Column) -> Column:
        def joined(ends: Column) -> Column:
            parts = F.zip_with(blocks, _before(ends, lambda x, y: F.greatest(x, y), long), part)
            return F.concat(F.array_join(parts, ""), F.substr(text, (F.array_max(ends) + 1).cast("int")))

        return _let(F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda s: s["stop"]))), joined)

    redacted = F.when(F.size("_spans") > 0, _let(_blocks(F.array_sort(F.col("_spans"))), whole)).otherwise(text)
    return found.withColumn("_text", redacted).select(*[F.col("_text").alias(c) if c == text_col else F.col(f"`{c}`") for c in cols]).withColumnsRenamed(back)
