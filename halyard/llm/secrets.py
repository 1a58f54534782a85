"""Operator 5: secret scans whose false positives a random forest removes, with DataFrame functions only.

Candidates are runs of characters that keys and tokens are made of, and what is assigned to a word like password. Each is
described by its length, the changes of character class and of vowel and consonant inside it, how much of it words of a
dictionary cover, the document's path, and the words beside it. A random forest trained on labelled findings votes; its trees are compiled to a column
expression, so scanning is one pass over the rows without a shuffle, however many candidates a text has. Only the
list of findings, which gives character offsets, shuffles its rows: digests and lengths, never texts.

The labelled findings are LABELLED rows made by rule from hashes of their number (labelled_findings); every fifth is
held out, and the tests ask for the forest's accuracy on those.

Cases: a null text counts as empty and has no candidate; a null path, or a table without that column, counts as empty;
repeated rows and equal candidates are judged each for itself; a vote that is tied is no secret; texts may have any
length; an empty table gives an empty result; other columns of the input stay or are ignored, whatever their names.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import unused
from halyard.llm.line_chunks import let

#: Labelled findings that the forest is trained on and tested with (four fifths and one fifth).
LABELLED = 5000
TREES, DEPTH, SEED = 15, 7, 11
#: Characters beside a candidate that are looked at.
NEAR = 48
REDACTED = "[SECRET]"
#: Frequent words and parts of words of four languages, three letters or more.
DICTIONARY = """the and tion ing ment ther that with for are was this from have not but all one you her his ent ion ati
con per pro pre ter der die und ein ich sch ung heit keit lich mit auf des que les des est pour dans sur con una los las
por para como eux aux ais oir ance ence able ible ness less ship user name account config value index table string
number get set list data file path test main class method function service manager handler request response client
server version update delete create order item page view model controller""".split()
#: Words beside secrets, and beside what only looks like one.
TELLING = "password|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential|private"
#: Candidates: eight characters or more that aren't blank, up to a quote, after an assignment to a telling word; and
#: sixteen characters or more of keys, tokens, digests and identifiers. The first two look-behinds are cheap and come first.
ASSIGNED = rf"(?<=[=:>\s\"'`])(?<=[=:]>?\s{{0,2}}[\"'`]?)(?<=(?i:{TELLING})[\"'`]?\s{{0,2}}[=:]{{1,2}}>?\s{{0,2}}[\"'`]?)[^\s\"'`]{{7,}}[^\s\"'`.,;:)\]}}>]"
CANDIDATE = rf"{ASSIGNED}|[A-Za-z0-9_+/-]{{16,}}={{0,2}}"
HARMLESS = "commit|sha1|sha256|md5|hash|digest|checksum|integrity|uuid|guid|etag|revision|example|sample|dummy|placeholder"
HARMLESS_PATH = "test|example|fixture|sample|mock|docs|vendor|node_modules|lock"

FEATURES = ["length", "class_changes", "vowel_changes", "digits", "upper", "distinct", "hex", "dictionary", "separators", "path_harmless", "near_telling", "near_harmless", "assigned", "symbols", "expression"]


def features(candidate: Column, left: Column, right: Column, path: Column) -> Column:
    """What the forest sees of a candidate, as a struct of doubles."""
    n = F.length(candidate).cast("double")
    lower, near = F.lower(candidate), F.lower(F.concat(left, F.lit(" "), F.substring(right, 1, NEAR // 2)))
    share = lambda pattern: F.length(F.regexp_replace(candidate, pattern, "")) / n
    runs = lambda classes: (F.length(F.regexp_replace(classes, r"(.)\1*", "$1")) - 1) / n
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(candidate, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0")
    vowels = F.regexp_replace(F.regexp_replace(F.regexp_replace(lower, "[aeiouy]", "a"), "[b-z]", "b"), "[0-9]", "0")
    flag = lambda text, pattern: text.rlike(pattern).cast("double")
    values = {
        "length": n,
        "class_changes": runs(classes),
        "vowel_changes": runs(vowels),
        "digits": share("[^0-9]"),
        "upper": share("[^A-Z]"),
        "distinct": F.size(F.array_distinct(F.split(candidate, ""))) / n,
        "hex": share("[^0-9a-f]"),
        "dictionary": 1 - F.length(F.regexp_replace(lower, "|".join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w))), "")) / n,
        "separators": share("[A-Za-z0-9]"),
        "path_harmless": flag(F.lower(path), HARMLESS_PATH),
        "near_telling": flag(F.lower(left), rf"({TELLING})[^a-z0-9]*$"),
        "near_harmless": flag(F.concat(near, lower), HARMLESS),
        "assigned": flag(left, r"[=:]\s{0,2}[\"']?$"),
        "symbols": share("[A-Za-z0-9_+/=-]"),
        "expression": flag(candidate, r"^(\$?\{|<)|[(\[]"),
    }
    return F.struct(*[values[f].cast("double").alias(f) for f in FEATURES])


def labelled_findings(spark: SparkSession, n: int = LABELLED) -> DataFrame:
    """(id, candidate, left, right, path, label): n findings made by rule from hashes of their numbers."""
    pick = lambda salt, size: F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(size)).cast("int")

    def chars(alphabet: str, length: Column | int, salt: int) -> Column:
        letter = lambda k: F.substr(F.lit(alphabet), F.pmod(F.xxhash64(F.col("id"), k, F.lit(salt)), F.lit(len(alphabet))).cast("int") + 1, F.lit(1))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length) if isinstance(length, int) else length), letter), "")

    def words(count: Column, salt: int, between: str, shape=lambda w: w) -> Column:
        word = lambda k: shape(F.get(F.array(*[F.lit(w) for w in DICTIONARY]), F.pmod(F.xxhash64(F.col("id"), k, F.lit(salt)), F.lit(len(DICTIONARY))).cast("int")))
        return F.array_join(F.transform(F.sequence(F.lit(1), count), word), between)

    word_of = lambda salt: words(F.lit(1), salt, "")
    low, up, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexes, plain = digit + "abcdef", words(pick(1, 4) + 2, 2, " ")
    lead = F.concat(plain, F.lit(" "))
    neutral = F.get(F.array(*[F.lit(x) for x in ("", "src/app/settings.py", "web", "notes.txt", "deploy/prod.env")]), pick(3, 5))
    tests = F.get(F.array(*[F.lit(x) for x in ("tests/fixtures/keys.py", "docs/example.md", "src/test/mock.json")]), pick(3, 3))
    key = F.get(F.array(*[F.lit(x) for x in ("password", "token", "secret", "api_key", "access_key", "auth_token")]), pick(4, 6))
    sign = F.get(F.array(*[F.lit(x) for x in ("=", " = ", ": ", ' = "', "='")]), pick(5, 5))
    benign = F.get(F.array(*[F.lit(x) for x in ("commit ", "sha256:", "checksum ", "digest: ", "etag=", "md5 = ")]), pick(6, 6))
    said = F.concat(lead, key, sign)
    # Their number has no divisor in common with five: each kind is among those held out.
    kinds: list[tuple[int, Column, Column, Column]] = [
        (1, F.concat(F.lit("AKIA"), chars(up + "234567", 16, 10)), lead, neutral),
        (1, F.concat(F.lit("AKIA"), chars(up + digit, 16, 11)), lead, neutral),
        (1, chars(hexes, 40, 12), said, neutral),
        (1, chars(hexes, pick(13, 17) + 16, 14), said, neutral),
        (1, F.concat(F.lit("ghp_"), chars(low + up + digit, 36, 15)), lead, neutral),
        (1, chars(low + up + digit + "+/", pick(16, 30) + 20, 17), said, neutral),
        (1, F.concat(F.lit("sk_live_"), chars(low + up + digit, 24, 18)), lead, neutral),
        (1, chars(low + up + digit + "+/", pick(19, 20) + 36, 20), lead, neutral),
        (0, F.rpad(words(pick(21, 4) + 5, 22, ""), 16, "ertinsho"), lead, neutral),
        (0, F.rpad(words(pick(21, 4) + 5, 23, ""), 16, "ertinsho"), said, neutral),
        (0, F.upper(F.rpad(words(pick(21, 3) + 5, 24, ""), 16, "ertinsho")), lead, neutral),
        (0, F.rpad(chars("aeiouyentrsldht", pick(25, 12) + 16, 26), 16, "a"), lead, neutral),
        (0, chars(hexes, 40, 27), F.concat(lead, benign), neutral),
        (0, chars(hexes, 64, 28), F.concat(lead, benign), neutral),
        (0, F.concat_ws("-", chars(hexes, 8, 29), chars(hexes, 4, 30), chars(hexes, 4, 31), chars(hexes, 4, 32), chars(hexes, 12, 33)), lead, neutral),
        (0, words(pick(34, 3) + 5, 35, "_"), lead, neutral),
        (0, F.concat(F.lit("src/"), words(pick(34, 3) + 5, 36, "/")), lead, neutral),
        (0, words(pick(34, 3) + 5, 37, "", F.initcap), lead, neutral),
        (0, chars(digit, pick(38, 10) + 16, 39), lead, neutral),
        (0, chars(hexes, pick(40, 24) + 16, 41), said, tests),
        (0, F.concat(F.lit("AKIA"), chars(up, 9, 42), F.lit("EXAMPLE")), lead, tests),
        (0, chars("-_", pick(43, 40) + 16, 44), lead, neutral),
        (1, chars(low + up + digit, pick(51, 8) + 8, 52), said, neutral),
        (1, chars(low + up + digit + "!@#$&.%*?", pick(53, 12) + 8, 54), said, neutral),
        (1, F.concat(F.initcap(word_of(55)), chars(digit, pick(56, 3) + 2, 57), chars("!@#$.", 1, 58), chars(low + digit, 4, 59)), said, neutral),
        (1, F.concat(F.initcap(F.translate(F.rpad(word_of(60), 6, "adore"), "oeai", "0341")), chars(digit, pick(61, 3) + 2, 62)), said, neutral),
        (0, F.rpad(words(pick(63, 2) + 2, 64, ""), 8, "ertinsho"), said, neutral),
        (0, F.concat(word_of(65), chars("_.", 1, 66), F.rpad(words(pick(67, 2) + 1, 68, "_"), 6, "value"), F.lit("()")), said, neutral),
        (0, F.concat(F.lit("${"), F.upper(F.rpad(words(pick(69, 2) + 1, 70, "_"), 6, "value"))), said, neutral),
        (0, F.concat(F.lit("<your-"), F.rpad(words(pick(71, 2) + 1, 72, "-"), 4, "value")), said, neutral),
        (0, F.rpad(words(pick(73, 2) + 2, 74, "", F.initcap), 9, "ErtinValue"), said, neutral),
    ]
    kind = F.pmod(F.col("id"), F.lit(len(kinds)))
    chosen = reduce(lambda e, x: e.when(kind == x[0], x[1]), enumerate(F.struct(c.alias("candidate"), left.alias("left"), path.alias("path"), F.lit(y).cast("double").alias("label")) for y, c, left, path in kinds), F)
    made = spark.range(0, n, 1, 1).select("id", chosen.alias("x"))
    return made.select("id", "x.candidate", "x.left", F.concat(F.lit(" "), words(F.lit(3), 50, " ")).alias("right"), "x.path", "x.label")


#: A tree is a vote, or (feature, threshold, tree if at most, tree if more).
Tree = float | tuple


def trained(spark: SparkSession, n: int = LABELLED, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[Tree]:
    """The forest that four fifths of n labelled findings give; trained once in a process for the same parameters."""
    key = (n, trees, depth, seed)
    if key not in _TRAINED:
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import VectorAssembler

        rows = labelled_findings(spark, n).filter(F.pmod("id", F.lit(5)) != 0)
        described = rows.select("label", features(F.col("candidate"), F.col("left"), F.col("right"), F.col("path")).alias("f")).select("label", "f.*")
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described).select("label", "features")
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(vectors)
        _TRAINED[key] = read_forest(model.toDebugString)
    return _TRAINED[key]


_TRAINED: dict[tuple, list[Tree]] = {}


def read_forest(said: str) -> list[Tree]:
    """The trees of a forest from its description, which prints each node before the nodes below it."""
    lines = iter([line.strip() for line in said.splitlines() if re.match(r"\s*(If|Else|Predict)", line)])

    def node() -> Tree:
        line = next(lines)
        if line.startswith("Predict"):
            return float(line.split(":")[1])
        feature, threshold = re.fullmatch(r"If \(feature (\d+) <= (.*)\)", line).groups()
        at_most = node()
        next(lines)  # Else
        return FEATURES[int(feature)], float(threshold), at_most, node()

    return [node() for _ in range(len(re.findall(r"(?m)^\s*Tree \d+ ", said)))]


def votes(forest: list[Tree], described: Column) -> Column:
    """The share of trees that take a candidate for a secret."""

    def column(tree: Tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        feature, threshold, at_most, more = tree
        return F.when(described[feature] <= threshold, column(at_most)).otherwise(column(more))

    return reduce(lambda a, b: a + b, [column(t) for t in forest]) / len(forest)


def judged(text: Column, path: Column, forest: list[Tree]) -> Column:
    """(gaps, found): the stretches between candidates, one more than candidates, and of each candidate itself and its vote."""

    def of_parts(parts: Column) -> Column:
        gaps, candidates = parts["gaps"], parts["candidates"]

        def one(candidate: Column, i: Column) -> Column:
            left, right = F.substring(F.get(gaps, i), -NEAR, NEAR), F.substring(F.get(gaps, i + 1), 1, NEAR)
            vote = let(features(candidate, left, right, path), lambda f: votes(forest, f))
            return F.struct(candidate.alias("candidate"), vote.alias("vote"))

        return F.struct(gaps.alias("gaps"), F.transform(candidates, one).alias("found"))

    return let(F.struct(F.split(text, CANDIDATE, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("candidates")), of_parts)


def _judged(df: DataFrame, text_col: str, path_col: str | None) -> Column:
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    path = F.coalesce(df[path_col].cast("string"), F.lit("")) if path_col in df.columns else F.lit("")
    return judged(text, path, trained(df.sparkSession))


def findings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(id_col, at, start, end, n_chars, shown, sha256, vote, is_secret): every candidate of every text, with what the forest says.

    start and end count code points; shown is the candidate's first four characters.
    """
    rows = df.select(df[id_col].alias("id"), _judged(df, text_col, path_col).alias("judged")).filter(F.size("judged.found") > 0).withColumn("row", F.monotonically_increasing_id())
    each = rows.select("id", "row", F.transform("judged.gaps", F.length).alias("gaps"), F.posexplode("judged.found").alias("at", "x"))
    each = each.select("id", "row", "at", F.get("gaps", F.col("at")).cast("long").alias("gap"), F.length("x.candidate").cast("long").alias("n_chars"), F.substring("x.candidate", 1, 4).alias("shown"), F.sha2("x.candidate", 256).alias("sha256"), F.col("x.vote").alias("vote"))
    from pyspark.sql import Window

    so_far = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("n_chars")).over(so_far)
    return each.select(F.col("id").alias(id_col), "at", (end - F.col("n_chars")).alias("start"), end.alias("end"), "n_chars", "shown", "sha256", "vote", (F.col("vote") > 0.5).alias("is_secret"))


def redacted(df: DataFrame, text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """df with REDACTED in text_col in place of every secret; texts without one stay as they are."""
    name = unused(df, "judged")
    rows = df.withColumn(name, _judged(df, text_col, path_col))
    found = F.col(f"{name}.found")
    shown = F.concat(F.transform(found, lambda x: F.when(x["vote"] > 0.5, F.lit(REDACTED)).otherwise(x["candidate"])), F.array(F.lit("")))
    text = F.array_join(F.zip_with(F.col(f"{name}.gaps"), shown, lambda gap, x: F.concat(gap, x)), "")
    new = F.when(F.exists(found, lambda x: x["vote"] > 0.5), text).otherwise(F.col(text_col))
    return rows.select(*[(new.alias(c) if c == text_col else F.col(c)) for c in df.columns])
