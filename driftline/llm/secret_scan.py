"""Secret scanning: candidates by pattern, false positives removed by a random forest.

The scan, the features and the forest's votes are DataFrame expressions and JVM code. The
forest is trained from labelled findings: a table of (before, candidate, after, path, label),
such as `example_findings` makes by rule where none has been collected. Its dictionary and its letters' transitions come from the
documents' own words, of which every other one is kept for examples of what isn't a secret, so no example is made of dictionary words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

BEFORE, AFTER = 48, 24  # characters of context
TREES, DEPTH, SEED = 24, 7, 7
EXAMPLES = 8000
DICTIONARY_WORDS = 1500  # the most frequent words of four letters and more; as many others are for examples
CUT = 0.5

# fixed values: words that are read around and inside candidates
KEY_WORDS = "token secret password passwd pwd apikey api_key api-key access_key private_key auth bearer credential client_secret signature"
PLAIN_WORDS = "commit sha1 sha256 md5 checksum digest revision uuid guid etag hash image version isbn example sample dummy placeholder"
PLAIN_PATHS = "test tests fixture fixtures example examples docs doc vendor node_modules dist lock min.js .md"
ASSIGNED = "password passwd pwd passphrase secret token api_key api-key apikey access_key client_secret"
PLACEHOLDERS = "changeme your_password yourpassword password123 placeholder none_given undefined example_value ${TOKEN} os.environ process.env xxxxxxxx"
SPARE_WORDS = "value name data file path home user index list item page type"  # where documents have no words

_ASSIGN = r"[\"']?[ \t]{0,2}(?:=>|=|:)[ \t]{0,2}"
#: what comes before a value that is found by it: the word of a key and an assignment, or a user's name in an address
PREFIX = rf"(?:(?i:{'|'.join(ASSIGNED.split())}){_ASSIGN}[\"']?|://[^\s:/@\"']{{1,64}}:)"
#: a value after such a word, one in an address, the head of a private key, or a long run that isn't a name with a value
FOUND = (
    rf"(?i:{'|'.join(ASSIGNED.split())}){_ASSIGN}[\"']?[^\s\"'`,;<>]{{6,}}"
    r"|://[^\s:/@\"']{1,64}:[^\s/@\"']{3,64}@"
    r"|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
    rf"|[A-Za-z0-9_+/\-]{{16,}}+(?:={{1,2}}(?![A-Za-z0-9_+/=\"'-]))?+(?!{_ASSIGN}[\"']?[A-Za-z0-9])"
)
FEATURES = [
    "length", "digits", "upper", "lower", "symbols", "transitions", "runs", "likely", "dictionary", "hex", "numeric", "known_form", "placeholder",
    "quoted", "assigned", "key_near", "plain_near", "plain_path", "in_path",
]


@dataclass
class Lexicon:
    """Words of the documents: the dictionary, others for examples, and by pairs of letters how likely the second is after the first (log 2)."""

    words: list[str]
    others: list[str]
    transitions: list[float]


def lexicon(docs: DataFrame, text_col: str = "text", words: int = DICTIONARY_WORDS) -> Lexicon:
    """From the counts of all words of a to z, of 4 to 20 letters, in all whole texts; the driver gets the 2 * words most frequent."""
    found = F.explode(F.regexp_extract_all(F.lower(docs[text_col]), F.lit(r"(?<![\p{L}\d_])[a-z]{4,20}(?![\p{L}\d_])"), F.lit(0)))
    top = docs.select(found.alias("word")).groupBy("word").count().orderBy(F.desc("count"), "word").limit(2 * words).collect()
    pairs = [[0.5] * 26 for _ in range(26)]
    for r in top:
        for x, y in zip(r.word[:-1], r.word[1:], strict=True):
            pairs[ord(x) - 97][ord(y) - 97] += r["count"]
    likely = [round(math.log2(n / sum(row)), 4) for row in pairs for n in row]
    return Lexicon([r.word for r in top[::2]], [r.word for r in top[1::2]], likely)


def _trie(words: list[str]) -> str:
    """A pattern of the words, the longest first, that shares their beginnings."""
    nodes: dict = {}
    for w in words:
        at = nodes
        for ch in w:
            at = at.setdefault(ch, {})
        at[""] = {}

    def pattern(node: dict) -> str:
        rest = "|".join(ch + pattern(sub) for ch, sub in sorted(node.items()) if ch)
        return "" if not rest else f"(?:{rest})" + ("?" if "" in node else "")

    return pattern(nodes) or "(?!)"


def _any(words: str) -> str:
    return "(?i)(" + "|".join(w.replace(".", r"\.").replace("$", r"\$").replace("{", r"\{").replace("}", r"\}") for w in words.split()) + ")"


def _share(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)) / F.greatest(F.length(c), F.lit(1))


def features(before: Column, c: Column, after: Column, path: Column, known: Lexicon) -> dict[str, Column]:
    """What the forest sees of a candidate and its neighbourhood. Nulls count as empty."""
    before, c, after, path = (F.coalesce(x, F.lit("")) for x in (before, c, after, path))
    rest = F.length(F.regexp_replace(F.lower(c), _trie(known.words), ""))
    flag = lambda x: x.cast("double")
    change = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    letters = F.substring(F.regexp_replace(F.lower(c), "[^a-z]", ""), 1, 200)
    table = F.array(*[F.lit(x) for x in known.transitions])
    code = lambda x, k: F.ascii(F.substring(x, k, F.lit(1))) - 97
    steps = F.sequence(F.lit(1), F.length(letters) - 1)
    total = F.aggregate(steps, F.lit(0.0), lambda t, k: t + F.element_at(table, code(letters, k) * 26 + code(letters, k + 1) + 1))
    path = F.concat_ws(" ", path, F.regexp_extract(before, r"((?:[\w.-]*[/\\])+[\w.-]+)[^/\\]*$", 1))
    return {
        "length": F.least(F.length(c), F.lit(200)).cast("double"),
        "digits": _share(c, "[0-9]"),
        "upper": _share(c, "[A-Z]"),
        "lower": _share(c, "[a-z]"),
        "symbols": _share(c, r"[^A-Za-z0-9]"),
        "transitions": _share(c, change),
        "runs": _share(c, r"(.)(?=\1)"),
        "likely": F.when(F.length(letters) > 1, total / (F.length(letters) - 1)).otherwise(0.0),
        "dictionary": 1 - rest / F.greatest(F.length(c), F.lit(1)),
        "hex": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "numeric": flag(c.rlike("^[0-9]+$")),
        "known_form": flag(c.rlike(r"^(AKIA|ASIA|gh[pousr]_|sk[-_]|xox[bp]-|AIza|eyJ|glpat-|-----BEGIN)")),
        "placeholder": flag(c.rlike(_any(PLACEHOLDERS)) | c.rlike(r"^\$|^\W*$|^(.)\1+$|\(")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "assigned": flag(before.rlike("(=|:|=>)\\s*[\"'`]?$")),
        "key_near": flag(before.rlike(_any(KEY_WORDS))),
        "plain_near": flag(F.concat_ws(" ", before, after).rlike(_any(PLAIN_WORDS))),
        "plain_path": flag(path.rlike(_any(PLAIN_PATHS))),
        "in_path": flag(before.rlike(r"[./\\]$") | c.rlike(r"/.*/")),
    }


def example_findings(spark: SparkSession, known: Lexicon, rows: int = EXAMPLES) -> DataFrame:
    """Labelled findings (before, candidate, after, path, label) made by rule from row numbers; label 1 is a real secret.

    Half are random strings of the forms that secrets have, after a key word as a rule; the
    others are words, numbers, digests named as such, identifiers, paths and placeholders, made of words that aren't in the dictionary.
    """
    at = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 20))
    pick = lambda k, items: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in items]), (at(k) % len(items) + 1).cast("int"))
    seed = lambda k: F.concat(F.col("id").cast("string"), F.lit(f":{k}"))
    hexes = F.sha2(seed(1), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(F.concat(hexes, F.sha2(seed(2), 256)))), r"\s", "")
    alnum = F.regexp_replace(b64, "[+/=]", "")
    cut = lambda s, k, least, most: F.substring(s, F.lit(1), (at(k) % (most - least + 1) + least).cast("int"))
    texts = F.split(F.lit(" ".join(known.others or SPARE_WORDS.split())), " ")
    pick_word = lambda k: F.element_at(texts, (at(k) % F.size(texts) + 1).cast("int"))
    mixed = F.concat(F.substring(alnum, 50, 5), pick(60, ["!", "#", "$", ".", "@", "-"]), cut(alnum, 61, 3, 9))
    worded = F.concat(pick_word(66), F.substring(hexes, 34, 1), pick(67, ["!", "#", "$", "?", "."]), F.substring(hexes, 36, 2))
    pass_like = pick(62, [mixed, worded, F.concat(F.initcap(pick_word(63)), F.substring(hexes, 30, 3), pick(64, ["!", "#", "?", ""])), cut(alnum, 65, 8, 14)])
    secret = pick(
        3,
        [
            F.substring(hexes, 1, 40), cut(hexes, 4, 24, 64), F.upper(F.substring(hexes, 1, 40)), cut(b64, 5, 24, 64), cut(alnum, 6, 20, 48),
            F.concat(F.lit("AKIA"), F.upper(F.substring(alnum, 1, 16))), F.concat(F.lit("ghp_"), F.substring(alnum, 1, 36)), F.concat(F.lit("sk-"), F.substring(alnum, 1, 40)),
            pass_like, pass_like, F.lit("-----BEGIN RSA PRIVATE KEY-----"),
        ],
    )
    kind = (at(48) % 10).cast("int")
    secret = F.when(kind < 8, secret).otherwise(cut(b64, 57, 24, 64))  # what no key word tells must be random
    word = F.concat(*[pick_word(10 + k) for k in range(2)], F.when(at(16) % 2 == 0, pick_word(12)).otherwise(F.lit("")))
    word = F.when(F.length(word) < 16, F.concat(word, pick_word(13), pick_word(14))).otherwise(word)
    word = F.when(at(9) % 3 == 0, F.upper(word)).when(at(9) % 3 == 1, F.initcap(word)).otherwise(word)
    snake = F.concat_ws("_", *[pick_word(20 + k) for k in range(3)], F.lit("settings"))
    slash = F.concat_ws("/", *[pick_word(30 + k) for k in range(3)], F.lit("index"))
    number = F.substring(F.regexp_replace(F.concat(F.conv(F.substring(hexes, 1, 12), 16, 10), F.conv(F.substring(hexes, 13, 12), 16, 10)), "[^0-9]", ""), 1, 16)
    uuid = F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12))
    filler = F.concat_ws(" ", pick_word(40), pick_word(41), pick_word(42))
    opened = F.concat(filler, F.lit(" "), pick(43, KEY_WORDS.split()), pick(44, [' = "', ': "', "='", ": ", "=", " => '", "_VALUE="]))
    named = F.concat(filler, F.lit(" "), pick(45, PLAIN_WORDS.split()), pick(46, [" ", ": ", ' = "', "="]))
    prose = F.concat(filler, pick(47, [" ", ", ", ". ", "\n", "| "]))
    label = F.col("id") % 2 == 0
    plain_path = pick(52, ["tests/fixtures/a.json ", "docs/guide.md ", "node_modules/x/dist/y.min.js ", ""])
    address = F.concat(filler, F.lit(" postgres://"), pick_word(53), F.lit(":"))
    positive_before = F.when(secret.startswith("-----"), prose).when(kind < 7, opened).when(kind == 7, address).otherwise(F.concat(prose, F.lit('"')))
    negative = (
        F.when(kind < 3, word).when(kind == 3, number).when(kind == 4, F.substring(hexes, 1, 40)).when(kind == 5, uuid).when(kind == 6, snake)
        .when(kind == 7, slash).when(kind == 8, pick(54, [F.concat(F.lit("your_"), word), pick_word(55), *PLACEHOLDERS.split()]))
        .otherwise(F.repeat(pick(49, ["x", "0", "*-", "abcd", "1234"]), F.lit(24)))
    )
    fixture = at(56) % 12 == 0  # a secret's form in a place for examples
    negative = F.when(fixture, secret).otherwise(negative)
    negative_before = F.when(fixture, F.concat(F.lit("tests/fixtures/a.json "), pick(43, KEY_WORDS.split()), F.lit(" = ")))
    negative_before = negative_before.when(kind.isin(4, 5), named).when(kind.isin(8, 9), opened).otherwise(F.concat(plain_path, prose))
    quote = F.regexp_extract(positive_before, "[\"']$", 0)
    path = F.when(label, pick(50, ["src/app.py", "config/prod.env", "", ""])).otherwise(pick(51, ["src/app.py", "config/prod.env", "docs/guide.md", "", ""]))
    return spark.range(0, rows, 1, 4).select(
        F.when(label, positive_before).otherwise(negative_before).alias("before"),
        F.when(label, secret).otherwise(negative).alias("candidate"),
        F.when(label, F.concat(quote, F.lit(" "), filler)).otherwise(F.concat(F.lit(" "), filler)).alias("after"),
        path.alias("path"),
        label.cast("int").alias("label"),
        F.col("id"),
    )


@dataclass
class Scanner:
    model: PipelineModel
    known: Lexicon


def train(findings: DataFrame, known: Lexicon, trees: int = TREES, depth: int = DEPTH) -> Scanner:
    """A random forest on the labelled findings; rows without a label of 0 or 1 are left out."""
    rows = findings.where("label in (0, 1)")
    seen = features(*[rows[x] for x in ("before", "candidate", "after", "path")], known)
    rows = written(rows.select("label", *[c.alias(k) for k, c in seen.items()]), "findings")
    join = VectorAssembler(inputCols=FEATURES, outputCol="__x")
    forest = RandomForestClassifier(
        featuresCol="__x", labelCol="label", probabilityCol="__p", rawPredictionCol="__r", predictionCol="__y", numTrees=trees, maxDepth=depth, seed=SEED
    )
    return Scanner(PipelineModel([join, forest.fit(join.transform(rows))]), known)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(doc_id, start, end, before, candidate, after, path) of every candidate in every whole text; offsets are code points.

    A value is the candidate, and what it was found by is the end of `before`. The context reaches over the two matches next to it.
    """
    path = docs[path_col].cast("string") if path_col else F.lit("")
    text = docs[text_col]
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        path.alias("path"),
        F.monotonically_increasing_id().alias("row"),
        F.regexp_extract_all(text, F.lit(FOUND), F.lit(0)).alias("found"),
        F.split(text, FOUND, -1).alias("between"),
    ).where(F.size("found") > 0)
    near = lambda c, k: F.coalesce(F.get(F.col(c), k), F.lit(""))

    def one(hit: Column, k: Column) -> Column:
        value = F.regexp_replace(F.regexp_replace(hit, "^" + PREFIX, ""), "^(?!-----BEGIN)(.*)@$", "$1")
        value = F.when(hit.rlike("^" + PREFIX), value).otherwise(hit)
        lead = F.length(F.regexp_extract(hit, f"^({PREFIX})", 1))
        last = lambda c, n: F.right(c, F.lit(n))
        before = F.concat(last(near("between", k - 1), BEFORE), near("found", k - 1), last(near("between", k), BEFORE), F.substring(hit, F.lit(1), lead))
        rest = F.substring(hit, lead + F.length(value) + 1, F.lit(AFTER))
        after = F.concat(rest, F.left(near("between", k + 1), F.lit(AFTER)), near("found", k + 1), F.left(near("between", k + 2), F.lit(AFTER)))
        return F.struct(
            value.alias("candidate"), (F.length(near("between", k)) + F.length(hit)).alias("step"), (F.length(hit) - lead).alias("back"),
            last(before, BEFORE).alias("before"), F.left(after, F.lit(AFTER)).alias("after"),
        )

    slim = rows.select("doc_id", "path", "row", F.posexplode(F.transform("found", one)).alias("k", "it"))
    # rows of matches, not of texts; a text's are in one place
    run = Window.partitionBy("row").orderBy("k")
    start = (F.sum("it.step").over(run) - F.col("it.back")).cast("long")
    out = slim.select("doc_id", "path", "it.*", start.alias("start"))
    return out.select("doc_id", "start", (F.col("start") + F.length("candidate")).alias("end"), "before", "candidate", "after", "path")


def scan(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """One row per candidate: doc_id, start, end, candidate_sha256, score, is_secret.

    score is the share of the forest's votes for a secret; is_secret is score >= CUT, other candidates are
    the false positives. The candidate itself is not in the result. Null and empty texts have no candidates; rows that
    repeat, also with null ids, are scanned each; a null path is an empty one; other columns are ignored.
    """
    found = candidates(docs, id_col, text_col, path_col)
    seen = features(*[found[x] for x in ("before", "candidate", "after", "path")], scanner.known)
    rows = found.select("doc_id", "start", "end", F.sha2("candidate", 256).alias("candidate_sha256"), *[c.alias(k) for k, c in seen.items()])
    voted = scanner.model.transform(rows).withColumn("score", F.round(vector_to_array("__p")[1], 6))
    return voted.select("doc_id", "start", "end", "candidate_sha256", "score", (F.col("score") >= CUT).alias("is_secret"))
