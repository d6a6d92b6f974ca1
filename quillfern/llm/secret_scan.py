"""Secret scans: a random forest removes false positives among candidates, in DataFrame functions only.

Candidates are unbroken runs of at least 16 token characters with a digit; '=' belongs to a run at its end alone, as padding,
so that a name and its sign stay before it. Runs with a known prefix are candidates without a digit, and so is what stands after a
naming word and a sign, of any length and alphabet: in quotes up to the closing one, else up to a blank, '<', '>' or quote. Each has statistics of the run
(length, changes of character class, distinct characters, dictionary coverage), of the words
around it (other candidates included) and of the path (here the document's source). A random forest trained from labelled findings
gives the share of votes for a secret; its trees become one SQL expression, evaluated inside the text's
row. So a scan is one pass over the texts without shuffle, join or limit on candidates.

Defined cases: null and empty texts have no candidates; ties at the threshold count as secrets; equal
rows get equal results; labelled findings of one class alone make the forest constant; an empty table gives an
empty result. Extra columns are kept by redact(), whatever their names, and ignored by scan().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = "A-Za-z0-9_+/-"
#: A candidate: whole run of token characters, 16 or more, at least one digit, with its padding.
CANDIDATE = f"(?<![{TOKEN}])(?=[{TOKEN}]{{16}}|[{TOKEN}]{{15}}=(?![{TOKEN}=])|[{TOKEN}]{{14}}==(?![{TOKEN}=]))[A-Za-z_+/-]*[0-9][{TOKEN}]*(?:={{1,2}}(?![{TOKEN}=]))?"
#: The first characters of keys of known services, which need no digit.
PREFIX = "(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|[sr]k_live_|AIza)"
PREFIXED = f"(?<![{TOKEN}]){PREFIX}[{TOKEN}]*(?<=[{TOKEN}]{{16}})"
MASK = "[SECRET]"
CONTEXT = 48

#: Words that name a secret, words that name something harmless, and dictionary words inside runs.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "auth", "bearer", "credential", "private", "client_secret", "signing")
HARMLESS_WORDS = ("sha1", "sha256", "sha512", "md5", "commit", "checksum", "integrity", "digest", "etag", "uuid", "guid", "card", "order", "invoice", "phone", "isbn", "version", "revision", "example", "placeholder", "hash", "id")
#: A name that holds a naming word, with its sign and quote (group 1), then the value.
NAMED = (
    "((?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]*?(?=[abcpstABCPST])(?i:" + "|".join(SECRET_WORDS) + ")[sS]?(?:[_.0-9-][A-Za-z0-9_.-]*|[A-Z][A-Za-z0-9]*)?"
    "[\"']?[ \\t]{0,4}(?::=|=>|={1,3}|:)[ \\t]{0,4}[\"'`]?)"
    "(?:(?<=\")[^\"\\r\\n]+(?=\")|(?<=')[^'\\r\\n]+(?=')|(?<=`)[^`\\r\\n]+(?=`)"
    "|[^\\s\"'`<>&;]+(?:[&;](?![A-Za-z0-9_]+=)[^\\s\"'`<>&;]*){0,40}(?<![,.;:)\\]}]))"
)
SCANNED = f"{NAMED}|{PREFIXED}|{CANDIDATE}"
DICTIONARY = ("the", "and", "test", "example", "sample", "dummy", "fake", "your", "here", "change", "token", "secret", "password", "key", "value", "name", "file", "path", "image", "version", "copy", "data", "user", "page", "index", "article", "license", "placeholder", "redacted", "config", "default", "insert", "project", "module", "class", "function", "xxxx", "abcd", "1234", "0000")
PATH_WORDS = ("test", "example", "sample", "doc", "fixture", "mock", "vendor")
FEATURES = ("length", "transitions", "distinct_share", "digit_share", "upper_share", "hex_only", "digits_only", "coverage", "secret_before", "harmless_before", "secret_near", "assigned", "quoted", "path_harmless", "letters_only", "symbol_share", "prefixed", "reference")


def _any(words: tuple[str, ...]) -> str:
    return "(" + "|".join(words) + ")"


def feature_columns(run: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """The features of a candidate run, of up to CONTEXT characters on both sides and of the path, as doubles."""
    n = F.greatest(F.length(run), F.lit(1)).cast("double")
    low, left, right = F.lower(run), F.lower(before), F.lower(after)
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    count = lambda s, rx: F.regexp_count(s, F.lit(rx)).cast("double")
    return {
        "length": n,
        "transitions": count(run, "(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])") / n,
        "distinct_share": F.size(F.array_distinct(F.split(run, ""))) / n,
        "digit_share": count(run, "[0-9]") / n,
        "upper_share": count(run, "[A-Z]") / n,
        "hex_only": flag(run.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "digits_only": flag(run.rlike("^[0-9-]+$")),
        "coverage": (n - F.length(F.regexp_replace(low, _any(DICTIONARY), ""))) / n,
        "secret_before": flag(left.rlike(_any(SECRET_WORDS) + "([^a-z]*|s?[_.0-9-][a-z0-9_.-]*[^a-z0-9]*)$")),
        "harmless_before": flag(left.rlike("\\b" + _any(HARMLESS_WORDS) + "[^a-z0-9]*$")),
        "secret_near": flag(F.concat(left, F.lit(" "), right).rlike(_any(SECRET_WORDS))),
        "assigned": flag(left.rlike("[=:]\\W*$")),
        "quoted": flag(left.rlike("[\"']$") & right.rlike("^[\"']")),
        "letters_only": flag(run.rlike("^[\\p{L} ]+$")),
        "symbol_share": count(run, "[^\\p{L}0-9]") / n,
        "prefixed": flag(run.rlike("^" + PREFIX)),
        "reference": flag(run.rlike("^[$<{%(\\[*]|^[a-z_]+[.(]|^(?i:none|null|true|false|undefined|x+)$")),
        "path_harmless": flag(F.lower(F.coalesce(path, F.lit(""))).rlike(_any(PATH_WORDS))),
    }


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """A table of labelled findings (run, before, after, path, label) in the forms that scanners report.

    Runs are digests of the row number, so the table is the same everywhere: keys of several
    alphabets and short passwords with digits or symbols behind naming words are secrets; checksums, ids, card and phone numbers, placeholders,
    identifiers, references and plain words are not. They are cut by the scan's own pattern from whole lines, a third of which hold a second finding.
    """
    base = spark.range(n).select("id", F.sha2(F.concat(F.lit("f"), "id"), 256).alias("h"), F.pmod(F.xxhash64("id"), F.lit(22)).cast("int").alias("kind"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(97)).cast("int").alias("r"))
    b64 = F.translate(F.base64(F.unhex("h")), "=", "")
    digits = F.substring(F.translate("h", "abcdef", "314159"), 1, 16)
    pick = lambda words, by: F.element_at(F.array(*map(F.lit, words)), F.pmod(by, F.lit(len(words))).cast("int") + 1)
    k, r = F.col("kind"), F.col("r")
    word = pick(("thon ", "see the ", "Und der ", "de la ", "of this ", "value ", ""), r)
    name = pick(SECRET_WORDS, r)
    sign = pick((" = ", "=", ": ", " := ", '": '), F.col("id"))
    quote = pick(('"', "'", ""), F.col("id") + r)
    secret = (k < 8) | k.between(16, 19)
    letters = F.translate("h", "0123456789", "ghjkmnopqr")
    b64s = F.translate(b64, "+/", "xy")
    length = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(6)).cast("int")
    run = (
        F.when(k < 3, F.substring("h", 1, 40))
        .when(k == 3, F.substring("h", 1, 32))
        .when(k < 6, F.substring(b64, 1, 40))
        .when(k == 6, F.concat(F.lit("AKIA"), F.upper(F.substring("h", 1, 16))))
        .when(k == 7, F.concat(F.lit("ghp_"), F.substring(b64, 1, 36)))
        .when(k == 8, F.substring("h", 1, 40))
        .when(k == 9, F.col("h"))
        .when(k == 10, F.substring("h", 1, 32))
        .when(k < 13, digits)
        .when(k == 13, F.concat(pick(("your_token_here_", "example-key-value-", "xxxxxxxxxxxxxxxx", "placeholder_secret_", "test_password_"), r), F.substring(digits, 1, 2)))
        .when(k == 14, F.concat(pick(("projectModuleIndex", "defaultConfigVersion", "image_file_name_", "pageArticleIndex"), r), F.substring(digits, 1, 3)))
        .when(k == 16, F.concat(F.substr(letters, F.lit(1), length + 4), F.substring(digits, 1, 2)))
        .when(k == 17, F.concat(F.substr(b64s, F.lit(1), length + 3), pick(("&", "!", "#", "@", "$", "%", "^", "*"), r), F.substring(b64s, 12, 3), F.substring(digits, 1, 1)))
        .when(k == 18, F.concat(F.lit("AKIA"), F.upper(F.substring(letters, 1, 16))))
        .when(k == 19, F.concat(F.substr(letters, F.lit(1), length + 3), F.substring(digits, 1, 1), F.substr(letters, F.lit(1), length + 3), F.substring(digits, 1, 1)))
        .when(k == 20, pick(("none", "null", "True", "required", "${TOKEN}", "<token>", "****", "os.environ", "process.env.TOKEN", "{{token}}", "getenv(x)", "string", "%(token)s", "see", "xxxx", "[hidden]", "12"), r))
        .when(k == 21, F.substr(letters, F.lit(1), length + 2))
        .otherwise(F.concat_ws("-", F.substring("h", 1, 8), F.substring("h", 9, 4), F.substring("h", 13, 4), F.substring("h", 17, 4), F.substring("h", 21, 12)))
    )
    plain = F.when(k.isin(13, 20, 21), F.concat(word, name, sign, quote)).when(k.isin(8, 9, 10, 15), F.concat(word, pick(HARMLESS_WORDS, r), pick((" ", ": ", "="), F.col("id")), quote)).otherwise(word)
    # Placeholders stand in tests, samples and documentation more often than elsewhere, real keys less often.
    quiet, usual = ("tests/", "docs/", "samples/", "fixtures/", "src/"), ("src/", "app/", "lib/", "config/", "tests/")
    path = F.concat(F.when(k.isin(13, 20), pick(quiet, F.xxhash64("id", F.lit(4)))).otherwise(pick(usual, F.xxhash64("id", F.lit(4)))), r.cast("string"))
    bare = k.isin(6, 7, 18) & (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(3)) > 0)  # prefixed keys stand without a naming word, too
    before = F.when(bare, F.concat(word, pick(("aws_key = ", "key: ", "", "id "), r), quote)).when(secret, F.concat(word, name, sign, quote)).otherwise(plain)
    after = F.concat(F.when(secret | k.isin(8, 9, 10, 13, 15, 20, 21), quote).otherwise(""), F.lit(" "), word)
    made = base.select("id", F.concat(before, run, after).alias("line"), path.alias("path"), F.when(secret, run).alias("secret"))
    second = made.select((F.col("id") - 1).alias("id"), F.col("line").alias("line2"), F.col("secret").alias("secret2")).where("id % 3 = 0")
    lines = made.join(second, "id", "left").select(F.concat_ws(" ", "line", "line2").alias("line"), "path", F.array_compact(F.array("secret", "secret2")).alias("secrets"))
    found = _contexts(lines, "line").select(F.explode("__context").alias("c"), "path", "secrets")
    return found.select("c.run", "c.before", "c.after", "path", F.array_contains("secrets", F.col("c.run")).cast("int").alias("label"))


def train_forest(findings: DataFrame, trees: int = 12, depth: int = 5, max_rows: int = 200_000, seed: int = 5):
    """A random forest from labelled findings; at most max_rows of them, chosen by the hash of their content."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    known = findings.where("label is not null and run is not null").orderBy(F.xxhash64("run", "before"), "run", "before", "after", "path", "label").limit(max_rows)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = known.select(*(v.alias(f) for f, v in feature_columns(F.col("run"), blank("before"), blank("after"), F.col("path")).items()), F.col("label").cast("double").alias("label"))
    made = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(made)


def forest_expression(model, values: dict[str, Column]) -> Column:
    """The share of votes for label 1 as one expression of nested conditions."""

    def walk(node) -> Column:
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return F.lit(float(stats[1] / sum(stats)) if len(stats) > 1 and sum(stats) else 0.0)
        split = node.split()
        return F.when(values[FEATURES[split.featureIndex()]] <= F.lit(split.threshold()), walk(node.leftChild())).otherwise(walk(node.rightChild()))

    votes = [walk(t._call_java("rootNode")) for t in model.trees]  # noqa: SLF001
    total = votes[0]
    for v in votes[1:]:
        total = total + v
    return total / len(votes)


def _contexts(df: DataFrame, text: str) -> DataFrame:
    """df with __runs, __gaps (the text between candidates) and __context (run and CONTEXT characters of the text on both sides of each)."""
    none = F.array().cast("array<string>")
    df = df.withColumn("__any", F.col(text).rlike(SCANNED))
    df = df.withColumn("__names", F.when(F.col("__any"), F.regexp_extract_all(text, F.lit(SCANNED), F.lit(1))).otherwise(none))
    df = df.withColumn("__whole", F.when(F.col("__any"), F.regexp_extract_all(text, F.lit(SCANNED), F.lit(0))).otherwise(none))
    df = df.withColumn("__runs", F.transform("__whole", lambda m, i: F.substr(m, F.length(F.get("__names", i)) + F.lit(1))))
    df = df.withColumn("__gaps", F.when(F.col("__any"), F.split(text, SCANNED)).otherwise(F.array(text)))
    df = df.withColumn("__gaps", F.transform("__gaps", lambda g, i: F.concat(g, F.coalesce(F.get("__names", i), F.lit("")))))
    # A gap and a run after it have two characters at least, so CONTEXT / 2 of them hold the context; ends alone are joined.
    n, most = F.lit(CONTEXT), F.lit(CONTEXT // 2)
    df = df.withColumn("__left", F.transform("__runs", lambda r, i: F.concat(F.right(F.get("__gaps", i), n), F.right(r, n))))
    df = df.withColumn("__right", F.transform("__runs", lambda r, i: F.concat(F.left(r, n), F.left(F.get("__gaps", i + F.lit(1)), n))))

    def around(r, i):
        before = F.concat(F.array_join(F.slice("__left", F.greatest(i - most, F.lit(0)) + F.lit(1), F.least(i, most)), ""), F.right(F.get("__gaps", i), n))
        after = F.concat(F.left(F.get("__gaps", i + F.lit(1)), n), F.array_join(F.slice("__right", i + F.lit(2), most), ""))
        return F.struct(r.alias("run"), F.right(before, n).alias("before"), F.left(after, n).alias("after"))

    return df.withColumn("__context", F.transform("__runs", around))


def _found(df: DataFrame, text: Column, path: Column, model, threshold: float) -> DataFrame:
    """df with __gaps (the text between candidates) and __marks (run, score, secret of each candidate)."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    df = df.withColumn("__text", t).withColumn("__path", F.coalesce(path.cast("string"), F.lit("")))
    df = _contexts(df, "__text")
    feats = F.transform("__context", lambda c: F.struct(c.run.alias("run"), *(v.alias(f) for f, v in feature_columns(c.run, c.before, c.after, F.col("__path")).items())))
    df = df.withColumn("__features", feats)
    marks = F.transform("__features", lambda x: F.struct(x.run.alias("run"), forest_expression(model, {f: x[f] for f in FEATURES}).alias("score")))
    df = df.withColumn("__scored", marks)
    return df.withColumn("__marks", F.transform("__scored", lambda m: F.struct(m.run.alias("run"), m.score.alias("score"), (m.score >= F.lit(threshold)).alias("secret"))))


def _redacted() -> Column:
    parts = F.transform("__gaps", lambda g, i: F.concat(g, F.coalesce(F.when(F.get("__marks", i).secret, F.lit(MASK)).otherwise(F.get("__marks", i).run), F.lit(""))))
    return F.array_join(parts, "")


def scan(docs: DataFrame, model, doc_id: str = "doc_id", text: str = "text", path: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """doc_id, n_candidates, spans (start, stop in code points, score of each secret) and redacted text of every row."""
    where = F.col(path) if path else F.lit("")
    df = _found(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__t"), where.alias("__p")), F.col("__t"), F.col("__p"), model, threshold)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint,score:double>>").alias("out"))

    def step(acc, g):
        begin = acc["at"] + F.length(g.gap)
        stop = begin + F.length(g.run)
        found = F.struct(begin.cast("long").alias("start"), stop.cast("long").alias("stop"), g.score.alias("score"))
        return F.struct(stop.cast("long").alias("at"), F.when(g.secret, F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

    pairs = F.transform("__marks", lambda m, i: F.struct(F.get("__gaps", i).alias("gap"), m.run.alias("run"), m.score.alias("score"), m.secret.alias("secret")))
    df = df.withColumn("__pairs", pairs).withColumn("spans", F.aggregate("__pairs", start, step, lambda acc: acc["out"]))
    return df.select("doc_id", F.size("__marks").cast("long").alias("n_candidates"), "spans", _redacted().alias("redacted"))


def redact(docs: DataFrame, model, text: str = "text", path: str | None = "source", threshold: float = 0.5, length: str | None = "n_chars") -> DataFrame:
    """docs with every secret of the text column masked; a text without secrets, or null, stays as it is. length: a column that holds the text's length, renewed where the text changes."""
    where = F.col(path) if path else F.lit("")
    # The row travels as one column, so that none of its own can clash with those made here.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text).alias("t"), where.alias("p"))
    df = _found(rows, F.col("t"), F.col("p"), model, threshold)
    df = df.withColumn("__hit", F.exists("__marks", lambda m: m.secret)).withColumn("__new", F.when(F.col("__hit"), _redacted()).otherwise(F.col("t")))
    own = lambda c: F.col("row").getField(c)
    new = {text: F.col("__new")} | ({length: F.when(F.col("__hit"), F.length("__new")).otherwise(own(length)).cast(docs.schema[length].dataType)} if length in docs.columns else {})
    return df.select(*(new.get(c, own(c)).alias(c) for c in docs.columns))
