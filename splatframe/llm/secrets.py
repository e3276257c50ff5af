"""Secret scans: candidate tokens by pattern, and a random forest that removes false positives.

Everything on the main path is DataFrame and SQL functions. Candidates are found in whole texts by one regular
expression; each is described by its length, its character classes and transitions between them, how much of it a
dictionary's words cover, the kind of source path it stands in, and its neighbouring words. The forest is Spark's
own, trained from labelled findings; its trees are then compiled to CASE expressions, so scoring stays inside
generated code and needs no shuffle.

The built-in labelled findings follow from a rule: random keys of several alphabets beside telling words are secrets;
words, names, paths, embedded data, numbers, hashes beside "commit", placeholders and repeated characters are not.

Null and empty texts have no findings. Very long texts are taken whole: a text's candidates are all judged at each of
their places, of any number and length. A repeated candidate gets its highest score, of ties the first place that has
it, and n_places. Null paths are no code. Repeated rows each give their findings; an empty table gives none; extra
columns, of any name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = r"[A-Za-z0-9_\-+/]"
#: What can be a candidate: a run of key characters, of any length from 16, or from 8 with a digit; after a prefix
#: that is followed by dots, its dotted parts too.
CANDIDATE = (
    rf"(?<!{_KEY})(?:(?:SG|eyJ{_KEY}++)(?:\.{_KEY}++)++|{_KEY}{{16,}}+|(?=[A-Za-z_\-+/]*+[0-9]){_KEY}{{8,}}+)={{0,2}}(?![A-Za-z0-9_\-+/=])"
)
#: Characters before and after a candidate that its features look at.
CONTEXT = 48
TREES = 24
DEPTH = 6
LABELLED = 3000
THRESHOLD = 0.5

# Words beside a candidate.
TELLING = ["password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "auth", "bearer", "credential", "private_key"]
HARMLESS = ["commit", "sha", "checksum", "md5", "example", "uuid", "etag", "version", "build", "page", "order", "isbn"]
#: The dictionary: common words of prose, of names in programs and of paths.
WORDS = (
    "about access account action active address after again agent alias also always amount animal answer apple array "
    "article author back base been before best better between block board body book build button cache call campaign "
    "case change check child city class client close cloud code color column comment config connect content control "
    "copy count country create current data date default delete demo design device digest document domain down draft "
    "edit email enable english error event every example export feature field file filter final first fixture folder "
    "font form found frame from function garden general global good great green group handle hash header height hello "
    "help here high history home host house image import index info input into item java join json just label language "
    "large last layout level library license light limit line link list live load local long look loop main make manager "
    "market master match media member menu message method minute mode model module money month more most move music name "
    "network never news next night note number object office only open option order other over page paper parent part path "
    "people photo place plain plan player point post power print private process product profile project public query "
    "question random read record release remote report request result return river road root sample school screen script "
    "search second section select server service session share short simple since site size small some sort source start "
    "state static status store stream street string style submit summer support system table target task temp test text "
    "that them then there thing this time title today total trace train travel tree type under unit update upload user "
    "value version video view water week what when where which white width window winter with word work world would "
    "write year your html http utils main"
).split()
PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "glpat-", "sk_live_", "xoxb-", "xoxp-", "AIza", "SG.", "eyJ"]

FEATURES = [
    "length", "digits", "uppers", "lowers", "others", "changes", "distinct", "hex_only", "covered", "known_prefix",
    "assigned", "quoted", "telling", "harmless", "code_path",
]


_CHUNK = 256
#: Pieces of a text that CONTEXT can reach over: a candidate has 8 characters or more, and what parts two has one.
_REACH = 2 * (CONTEXT // 9 + 1) + 1


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """(row, id, path, candidate, before, after, place), one row for each place of a candidate in a row's text.

    A text becomes its pieces: what stands before the first candidate, the candidate, what stands between, and so on.
    Contexts are read from neighbouring pieces, places from sums over chunks of pieces.
    """
    where = F.col(path).cast("string") if path else F.lit(None).cast("string")
    picked = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"), where.alias("path"), F.col(text).alias("text")
    )
    # Each step is bound by a generator, else the optimizer copies it into the functions that run for each candidate.
    bound = lambda df, keep, **made: df.select(*keep, F.inline(F.array(F.struct(*(F.expr(x).alias(n) for n, x in made.items())))))  # noqa: E731, E501
    keep = ["row", "id", "path"]
    split = bound(picked, keep, a=f"regexp_extract_all(text, r'{CANDIDATE}', 0)", g=f"split(text, r'{CANDIDATE}', -1)")
    split = split.filter(F.size("a") > 0)
    pieces = bound(split, [*keep, "a"], p="transform(sequence(0, 2 * size(a)), i -> if(i % 2 = 0, g[i div 2], a[i div 2]))")
    ends = bound(
        pieces, [*keep, "a"], n="transform(p, x -> cast(length(x) as long))",
        heads=f"transform(p, x -> left(x, {CONTEXT}))", tails=f"transform(p, x -> right(x, {CONTEXT}))",
    )
    summed = bound(
        ends, [*keep, "a", "n", "heads", "tails"],
        sums=f"aggregate(sequence(0, size(n) div {_CHUNK}), array(0L), (s, k) -> concat(s, array("
        f"element_at(s, -1) + aggregate(slice(n, k * {_CHUNK} + 1, {_CHUNK}), 0L, (t, x) -> t + x))))",
    )
    at = "(2 * i + 1)"  # pieces before candidate i
    done = f"({at} div {_CHUNK})"
    first = f"greatest({at} - {_REACH}, 0)"
    each = F.expr(
        "transform(a, (x, i) -> struct(x as candidate, "
        f"right(array_join(slice(tails, cast({first} + 1 as int), cast({at} - {first} as int)), ''), {CONTEXT}) as before, "
        f"left(array_join(slice(heads, {at} + 2, {_REACH}), ''), {CONTEXT}) as after, "
        f"1 + sums[cast({done} as int)] + aggregate(slice(n, cast({done} * {_CHUNK} + 1 as int), cast({at} - {done} * {_CHUNK} as int)), 0L, (t, y) -> t + y) as place))"
    )
    return summed.select(*keep, F.inline(each))


def described(found: DataFrame) -> DataFrame:
    """Adds FEATURES, as doubles, from candidate, before, after and path."""
    c = F.col("candidate")
    size = F.length(c).cast("double")
    count = lambda pattern: F.length(F.regexp_replace(c, f"[^{pattern}]", "")) / size
    classes = F.translate(
        c,
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-+/=",
        "U" * 26 + "l" * 26 + "d" * 10 + "o" * 5,
    )
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1"))
    fragment = "|".join(sorted(WORDS, key=lambda w: (-len(w), w)))
    covered = 1 - F.length(F.regexp_replace(F.lower(c), fragment, "")) / size
    near = F.lower(F.concat_ws(" ", "before", "after"))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    values = {
        "length": size,
        "digits": count("0-9"),
        "uppers": count("A-Z"),
        "lowers": count("a-z"),
        "others": count("_\\-+/=."),
        "changes": (runs - 1) / size,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(size, F.lit(40.0)),
        "hex_only": flag(c.rlike("^[0-9a-f]+$")),
        "covered": covered,
        "known_prefix": flag(c.rlike("^(" + "|".join(p.replace(".", "\\.") for p in PREFIXES) + ")")),
        "assigned": flag(F.col("before").rlike("[=:]\\s*[\"']?$")),
        "quoted": flag(F.col("before").rlike("[\"']$")),
        "telling": flag(near.rlike("|".join(TELLING))),
        "harmless": flag(near.rlike("\\b(" + "|".join(HARMLESS) + ")\\b")),
        "code_path": flag(F.lower("path").rlike("code|git|conf|env|src/")),
    }
    return found.withColumns({k: values[k].cast("double") for k in FEATURES})


def labelled_findings(spark: SparkSession, rows: int = LABELLED) -> DataFrame:
    """(candidate, before, after, path, label): by a rule over the row's number, the same on every run."""
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    pick = lambda words, salt: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))) + 1).cast("int"))  # noqa: E731, E501
    mixed = F.translate(F.base64(F.unhex(digest("m"))), "+/=", "xYz")
    upper = F.upper(F.translate(mixed, "xyz", "QRS"))
    word = F.concat_ws("_", pick(WORDS, 1), pick(WORDS, 2), pick(WORDS, 3), pick(WORDS, 4), pick(WORDS, 5))
    slug = F.concat(word, F.lit("-"), F.pmod(F.col("id"), F.lit(997)).cast("string"))
    plain = F.concat(pick(["see the page about ", "of the and in ", "then there was ", "order "], 6))
    kind = F.pmod("id", F.lit(20)).cast("int")
    secret = F.pmod("id", F.lit(20)) < 10
    parts = F.concat(*(F.rtrim(F.base64(F.unhex(digest(f"l{k}"))), F.lit("=")) for k in range(20)))
    size = lambda least, n: (F.lit(least) + F.pmod(F.xxhash64("id", F.lit(14)), F.lit(n))).cast("int")
    letters = F.translate(mixed, "0123456789", "qWeRtYuIoP")
    long = F.substr(parts, F.lit(1), size(120, 680))
    told = pick(TELLING, 7)
    dull = pick(HARMLESS, 8)
    rows_of = spark.range(rows)
    case = lambda *xs: F.coalesce(*(F.when(kind == k, x) for k, x in enumerate(xs)))
    return rows_of.select(
        case(
            F.concat(F.lit("AKIA"), F.substring(upper, 3, 16)),
            F.concat(pick(PREFIXES[2:9], 9), F.substring(mixed, 1, 36)),
            F.substring(digest("h"), 1, 40),
            F.substring(digest("p"), 1, 18),
            F.substring(mixed, 1, 24),
            F.substring(mixed, 1, 40),
            long,
            F.substr(letters, F.lit(1), size(16, 26)),
            F.substr(mixed, F.lit(1), size(8, 8)),
            F.concat(F.lit("SG."), F.substring(mixed, 1, 22), F.lit("."), F.substring(parts, 1, 43)),
            F.substring(digest("c"), 1, 40),
            slug,
            F.concat(F.lit("000"), F.format_string("%017d", F.col("id") * 7919)),
            F.repeat(F.concat(F.lit("x1"), F.lit("0")), 8),
            F.concat(F.lit("YOUR_KEY_HERE_"), F.pmod(F.col("id"), F.lit(100)).cast("string")),
            F.concat_ws("-", F.substring(digest("u"), 1, 8), F.substring(digest("u"), 9, 4), F.substring(digest("u"), 13, 4), F.substring(digest("u"), 17, 12)),
            F.concat_ws("_", told, dull, pick(WORDS, 15), pick(WORDS, 16)),
            F.concat(pick(WORDS, 1), pick(WORDS, 2), pick(WORDS, 3), F.pmod(F.col("id"), F.lit(997)).cast("string")),
            long,
            F.concat_ws("/", word, pick(WORDS, 15), pick(WORDS, 16)),
        ).alias("candidate"),
        F.when(kind == 18, F.concat(plain, F.lit("data:image/png;base64,")))
        .when(F.pmod(F.xxhash64("id", F.lit(10)), F.lit(3)) == 0, F.concat(plain, F.lit(" ")))
        .when(secret, F.concat(plain, told, pick(["=", ": ", " = \"", " = '"], 11)))
        .otherwise(F.concat(plain, dull, F.lit(" "))).alias("raw_before"),
        pick([" the end of it", "\" , and more", " of that", ""], 12).alias("after"),
        pick(["web", "code", "src3", "book"], 13).alias("path"),
        # A bare hash of 40 digits is a commit unless something tells; keys with a prefix or mixed letters are keys. Very
        # long, short and all-letter runs are keys only where something tells.
        secret.alias("is_secret"), kind.alias("kind"),
    ).select(
        "candidate", "after", "path",
        F.when(F.col("kind").isin(2, 3, 6, 7, 8) & ~F.lower("raw_before").rlike("|".join(TELLING)), F.concat("raw_before", F.lit("token = \"")))
        .otherwise(F.col("raw_before")).alias("before"),
        F.col("is_secret").cast("double").alias("label"),
    )


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 11):
    """A forest over FEATURES of labelled findings."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described(labelled))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)


def compiled(model) -> Column:
    """The forest's probability of a secret as one SQL expression: the mean over trees of nested CASEs."""

    def tree(node) -> str:
        if node.subtreeDepth() == 0:
            stats = node.impurityStats().stats()
            return f"{stats[1] / (stats[0] + stats[1])!r}D"
        split = node.split()
        name = FEATURES[split.featureIndex()]
        return f"CASE WHEN {name} <= {split.threshold()!r}D THEN {tree(node.leftChild())} ELSE {tree(node.rightChild())} END"

    parts = [tree(t._call_java("rootNode")) for t in model.trees]
    return F.expr("(" + " + ".join(parts) + f") / {len(parts)}D")


def scan(
    docs: DataFrame, model, doc_id: str = "doc_id", text: str = "text", path: str | None = "source",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per finding: doc_id, candidate, place (from 1), n_places, score, is_secret."""
    judged = described(candidates(docs, doc_id, text, path)).select("row", "id", "candidate", "place", compiled(model).alias("score"))
    best = judged.groupBy("row", "id", "candidate").agg(
        F.max(F.struct("score", (-F.col("place")).alias("place"))).alias("best"), F.count("*").alias("n_places")
    )
    score = F.col("best.score")
    return best.select(
        F.col("id").alias(doc_id), "candidate", (-F.col("best.place")).alias("place"), "n_places", score.alias("score"),
        (score >= threshold).alias("is_secret"),
    )
