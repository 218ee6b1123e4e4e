"""Secret scans: candidates by pattern, false positives removed by a random forest, with DataFrame functions only.

Candidates are runs of characters that keys are written in. Their features are length, changes between kinds of
characters, how much of them common words cover, whether they stand in a path, and the words around them. A random
forest trained on labelled findings tells secrets from checksums, identifiers, names and placeholders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blank

#: Least characters of a candidate, and of one that a secret's name and a sign stand before.
LEAST, LEAST_NAMED = 16, 6
#: Characters of context on either side that neighbouring words are looked for in.
REACH = 48
#: Words that stand before secrets, before other long strings, and common words in identifiers (fixed values).
BEFORE_SECRET = "token|secret|passwd|password|pwd|api[ _-]?key|apikey|access[ _-]?key|private[ _-]?key|auth|authorization|bearer|credential|client[ _-]?secret|signing[ _-]?key"
BEFORE_OTHER = "commit|sha1|sha256|sha512|md5|checksum|digest|hash|integrity|etag|uuid|guid|revision|version|build|example|sample|placeholder|isbn|doi|image|layer"
#: Where a run without digits may be a key and not a word: right after a sign or an opening quote, or a secret's name.
SIGNED = rf"""(?<=[=:@"'`])|(?<=[=:] )|(?<=(?i:{BEFORE_SECRET})\s)|(?<=://)"""
#: A whole run of at least LEAST characters of keys, with padding. A run ends at '=' and '@', as at any other
#: character; the slashes after a URL's scheme are no part of it.
LONG = rf"(?:(?<![A-Za-z0-9_+/~.-])(?!//)|(?<=//))(?:(?=[A-Za-z_+/~.-]*[0-9])|{SIGNED})[A-Za-z0-9_+/~.-]{{{LEAST},}}(?:={{1,2}}(?![A-Za-z0-9_+/=~.-])|(?![A-Za-z0-9_+/~.-]))"
#: A shorter run of any characters, right after such a word and '=' or ':', which is looked at only behind a sign or quote.
NAMED = rf"""(?:(?<=["'=:])|(?<=[=:] ))(?<=(?i:{BEFORE_SECRET})["']?\s{{0,2}}[=:]\s{{0,2}}["']?)[^\s"'<>,;()=:]{{{LEAST_NAMED},{LEAST - 1}}}(?![^\s"'<>,;()])"""
CANDIDATE = f"{LONG}|{NAMED}"
COMMON = "the|and|for|get|set|user|name|data|file|test|page|list|item|index|value|type|model|node|key|time|date|http|www|com|org|html|path|image|version|example|your|here|change|this|with|from|api|app|main|config|default|service|server|client|request|response|number|string|table|column|update|create|delete|insert|select|report|module|package|import|class|public|static|docs|blog|post|product|release|build"
FEATURES = ("length", "digits", "uppers", "lowers", "marks", "changes", "distinct", "hex", "covered", "longest_run", "in_path", "parts", "before_secret", "before_other", "assigned", "quoted", "uuid", "userinfo", "at")
#: Rows of the labelled findings made here when none are given, trees and their depth.
LABELLED, TREES, TREE_DEPTH = 15000, 24, 8
#: Parts that words are put together from as negatives (fixed values).
SYLLABLES = ("ver", "schaft", "un", "heit", "ment", "ation", "er", "ge", "que", "eau", "ing", "tion", "los", "ción", "mente", "able", "stadt", "ous", "ier", "ent", "lich", "ness", "pre", "con", "dis", "ter", "berg", "ure", "ado", "ist")


def features(token: str = "candidate", before: str = "before", after: str = "after") -> dict[str, Column]:
    """FEATURES of a candidate with the text before and after it."""
    t, n = F.col(token), F.length(token).cast("double")
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[0-9]+", "9"), "[A-Z]+", "A"), "[a-z]+", "a"), "[^9Aa]+", "-")
    left = F.lower(F.col(before))
    near = F.regexp_extract(left, r"((?:[^\s]+\s+){0,3}[^\s]*\s*)\z", 1)
    return {
        "length": F.log(n),
        "digits": count("[0-9]") / n,
        "uppers": count("[A-Z]") / n,
        "lowers": count("[a-z]") / n,
        "marks": count("[^A-Za-z0-9]") / n,
        "changes": (F.length(kinds) - 1) / n,
        "distinct": F.size(F.array_distinct(F.split(t, ""))) / F.least(n, F.lit(64.0)),
        "hex": t.rlike(r"\A(?:[0-9a-f]+|[0-9A-F]+)\z").cast("double"),
        "covered": 1 - F.length(F.regexp_replace(F.lower(t), COMMON, "")) / n,
        "longest_run": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(t, F.lit("[A-Za-z]+|[0-9]+"), F.lit(0)), F.length)), F.lit(0)) / n,
        # the user part of a URL: after its scheme, up to an @
        "userinfo": (left.rlike(r"://[^\s/@]*\z") & F.col(after).startswith("@")).cast("double"),
        "at": (F.col(after).startswith("@") | left.endswith("@")).cast("double"),
        "in_path": (F.col(before).rlike(r"[/\\][^\s/\\]*\z|://[^\s]*\z") | t.rlike(r"/[^/]+/")).cast("double"),
        "parts": F.size(F.split(t, "[_./-]")).cast("double"),
        "before_secret": near.rlike(BEFORE_SECRET).cast("double"),
        "before_other": near.rlike(BEFORE_OTHER).cast("double"),
        "assigned": left.rlike(r"[=:]\s*[\"']?\z").cast("double"),
        "quoted": (left.rlike("[\"'`]\\z") & F.col(after).rlike("\\A[\"'`]")).cast("double"),
        "uuid": t.rlike(r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z").cast("double"),
    }


def labelled_findings(spark: SparkSession, rows: int = LABELLED) -> DataFrame:
    """Findings (candidate, before, after, label, kind) made by rule from row numbers: all kinds in equal parts."""
    i = F.col("id")
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), i.cast("string")).cast("binary"), 256)
    pick = lambda salt, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64(F.lit(salt), i), F.lit(len(xs))) + 1).cast("int"))
    mixed = lambda salt, n: F.substring(F.translate(F.base64(F.unhex(digest(salt))), "+/=", "xZ7"), 1, n)
    hexed = lambda salt: F.substring(digest(salt), 1, F.element_at(F.array(F.lit(32), F.lit(40), F.lit(64)), (F.pmod(F.xxhash64(F.lit(salt), i), F.lit(3)) + 1).cast("int")))
    cased = lambda c: F.when(F.pmod(F.xxhash64(F.lit("case"), i), F.lit(5)) == 0, F.upper(c)).otherwise(c)
    name = pick("name", "token", "secret", "password", "api_key", "access_key", "auth_token", "client_secret", "TOKEN", "API_KEY", "Password")
    join = pick("join", "_", "-", ".")
    words = F.concat(pick("a", "get", "user", "report", "image", "page", "default"), join, pick("b", "name", "index", "model", "value", "list"), join, pick("c", "service", "version", "module", "table"), F.pmod(F.hash(i), F.lit(1000)).cast("string"))
    sign = pick("sign", " = \"", ": \"", "=", ": ", " = '", "=\"")
    close = F.when(sign.endswith('"'), F.lit('" ')).when(sign.endswith("'"), F.lit("' ")).otherwise(F.lit(" "))
    letters = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.element_at(F.array(*map(F.lit, SYLLABLES)), (F.pmod(F.xxhash64(F.lit("syllable"), i, k), F.lit(len(SYLLABLES))) + 1).cast("int"))), "")
    plain = F.translate(letters, "ó", "o")
    word = F.when(F.pmod(F.hash(F.lit("case"), i), F.lit(4)) == 0, F.upper(plain)).when(F.pmod(F.hash(F.lit("case"), i), F.lit(4)) == 1, plain).otherwise(F.initcap(plain))
    prose = pick("prose", "as we saw in ", "see the ", "of the ", "and then ", "")
    kinds = [
        (1, cased(hexed("k0")), F.concat(prose, name, sign), close),
        (1, mixed("k1", 40), F.concat(prose, name, sign), close),
        (1, F.concat(pick("pre", "sk_live_", "ghp_", "xoxb-", "AKIA", "pk_"), mixed("k2", 30)), F.concat(prose, pick("n2", "use ", "key ", "with ", "token = \"", "export KEY=")), F.lit(" ")),
        (1, F.concat(mixed("k3", 24), F.lit("."), mixed("k3b", 40)), F.concat(prose, pick("n3", "Authorization: Bearer ", "auth = \"", "bearer ", "token: ")), F.lit(" ")),
        (1, cased(hexed("k4")), F.concat(prose, name, F.lit(" ")), F.lit(" ")),
        (0, hexed("n0"), F.concat(prose, pick("h", "commit ", "sha256:", "md5 ", "checksum = ", "hash: ", "digest: \"", "revision ", "integrity=\"")), F.lit(" ")),
        (0, F.concat_ws("-", F.substring(digest("n1"), 1, 8), F.substring(digest("n1"), 9, 4), F.substring(digest("n1"), 13, 4), F.substring(digest("n1"), 17, 4), F.substring(digest("n1"), 21, 12)), F.concat(prose, pick("u", "uuid ", "id = \"", "id: ", "request ")), F.lit(" ")),
        (0, words, F.concat(prose, pick("w", "function ", "call ", "set ", "token = ", "key: ")), F.lit(" ")),
        (0, F.concat(F.lit("blog/"), pick("p", "release", "product", "docs", "report"), F.lit("/"), (F.pmod(F.hash(i), F.lit(9000)) + 1000).cast("string"), F.lit("/"), F.substring(digest("n3"), 1, 12)), pick("url", "https://example.org/", "see /var/www/", "at http://www.example.com/"), F.lit(" ")),
        (0, pick("ph", "your_api_key_here_1", "xxxxxxxxxxxxxxxx0000", "1234567890123456", "changeme_password_1", "0000000000000000", "example-token-12345", "abcdefghij0123456789", "4111111111111111"), F.concat(prose, name, sign), close),
        (1, F.concat(pick("pre5", "ghp_", "glpat-", "sk_live_", ""), mixed("k5", 32)), F.concat(prose, pick("u5", "https://user:", "postgres://u:", "https://", "redis://app:", "git clone https://ci:")), F.concat(F.lit("@"), pick("h5", "github.com/a/b ", "db ", "db.example.org:5432/x ", "host/path "))),
        (1, F.substring(hexed("k6"), 1, 32), F.concat(prose, pick("u6", "postgres://u:", "mysql://app:", "https://user:", "amqp://svc:")), F.lit("@db ")),
        (1, F.translate(mixed("k7", 40), "0123456789", "QwErTyUiOp"), F.concat(prose, name, sign), close),
        (1, F.concat(pick("pre8", "ghp_", "sk_live_", "npm_", ""), mixed("k8", 36)), F.concat(prose, pick("n8", "GITHUB_TOKEN=", "export API_KEY=", "DB_PASSWORD=", "?access_token=", "client_secret=")), F.lit(" ")),
        (0, F.concat(pick("w1", "inter", "counter", "trans", "super", "un"), pick("w2", "national", "comprehen", "formation", "revolution", "character"), pick("w3", "isation", "istically", "alities", "siveness", "ization")), prose, pick("w4", " ", ", ", ". ")),
        (0, F.concat(pick("j1", "state", "well", "long", "user", "attion"), pick("j", "-", "_", ".", "/"), pick("j2", "of", "known", "term", "name"), pick("j", "-", "_", ".", "/"), pick("j3", "the", "and", "service", "value"), pick("j", "-", "_", ".", "/"), pick("j4", "art", "company", "report", "settings")), F.concat(prose, pick("j5", "", "the ", "token = ", "see ")), F.lit(" ")),
        (0, F.concat(pick("m1", "firstname", "anna", "john.maria", "contact"), pick("m2", ".", "_"), pick("m3", "lastname", "schneider", "fitzgerald", "department"), F.when(F.pmod(i, F.lit(2)) == 0, F.pmod(F.hash(i), F.lit(100)).cast("string")).otherwise(F.lit(""))), F.concat(prose, pick("m4", "mail ", "to ", "<", "mailto:")), pick("m5", "@example.com ", "@mail.example.org ")),
        (0, pick("d1", "mail.example.org", "www.research.example.com", "subdomain.company.net", "github.com/user/project"), pick("d2", "anna@", "https://user:pw@", "https://", "at "), F.lit(" ")),
        (1, F.concat(pick("s9", "hunter", "dragon", "winter", "letmein", "Qwerty", "monkey"), F.pmod(F.hash(i), F.lit(90)).cast("string"), pick("t9", "", "pass9", "!", "Xy", "#1")), F.concat(prose, name, sign), close),
        (1, F.substring(mixed("k10", 14), F.lit(1), F.pmod(F.hash(i), F.lit(7)).cast("int") + 8), F.concat(prose, name, sign), close),
        (0, pick("n10", "required", "optional", "string", "undefined", "example", "changeme", "disabled", "your-key", "hidden", "username", "********", "xxxxxxxx", "ordinary", "invalid", "missing", "expired"), F.concat(prose, name, pick("sign10", ": ", " = ", "=", ": \"")), pick("end10", " ", "\" ", ". ")),
        (0, word, F.concat(prose, pick("v1", "", "the \"", "word: ", "called '", "der ", "note: ", "title=\"", "author: ", "https://", "see:", "Stadt: ")), pick("v2", " ", ", ", ". ", "\" ", "' ")),
        (0, F.concat(F.initcap(plain), pick("v3", "-", "_", "/", "."), pick("v4", "Verwaltung", "Department", "gouvernement", "universidad")), F.concat(prose, pick("v5", "", "the \"", "at: ", "name=", "(", "der ")), pick("v2", " ", ", ", ". ", "\" ", "' ")),
        (0, F.concat(plain, F.pmod(F.hash(F.lit("n"), i), F.lit(3000)).cast("string")), F.concat(prose, pick("v6", "", "file ", "chapter: ", "id=", "the ")), pick("v2", " ", ", ", ". ", "\" ", "' ")),
        (0, pick("r1", "................", "----------------", "________________", "--------------------------------", "~~~~~~~~~~~~~~~~~~"), prose, F.lit(" ")),
    ]
    rows_by_kind = None
    for k, (label, candidate, before, after) in enumerate(kinds):
        part = spark.range(0, rows // len(kinds), 1, 1).select(candidate.alias("candidate"), before.alias("before"), after.alias("after"), F.lit(float(label)).alias("label"), F.lit(k).alias("kind"))
        rows_by_kind = part if rows_by_kind is None else rows_by_kind.unionByName(part)
    return rows_by_kind


def train(findings: DataFrame, trees: int = TREES, depth: int = TREE_DEPTH, seed: int = 7):
    """A forest on labelled findings (candidate, before, after, label 0 or 1); null contexts count as empty."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    clean = findings.where(F.col("candidate").isNotNull() & F.col("label").isNotNull()).select("candidate", blank("before").alias("before"), blank("after").alias("after"), F.col("label").cast("double").alias("label"))
    # a forest draws rows by partition and place: both are made the same at every run
    rows = clean.repartition(8, "candidate").sortWithinPartitions("candidate", "before", "after", "label").withColumns(features())
    gather = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=3)
    return Pipeline(stages=[gather, forest]).fit(rows)


def candidates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key`, _row, _at, _skip, candidate, before, after: each occurrence of a candidate in a row's whole text, in its own context.

    _row is the row's own number, _at the occurrence's number in it, _skip the characters between the one before and it.
    """
    kinds = docs.select(F.monotonically_increasing_id().alias("_row"), key, blank(text).alias("_text"))
    found = kinds.withColumn("_all", F.regexp_extract_all("_text", F.lit(CANDIDATE), F.lit(0))).where(F.size("_all") > 0)
    # one gap more than runs; the context reaches over as many runs as fit in it
    gaps = found.select(key, "_row", "_all", F.split("_text", CANDIDATE, -1).alias("_gaps"))
    over = REACH // LEAST_NAMED + 1

    def piece(i: Column) -> Column:
        left = F.transform(F.sequence(F.greatest(i - over, F.lit(0)), i), lambda j: F.concat(F.when(j > F.greatest(i - over, F.lit(0)), F.get("_all", j - 1)).otherwise(F.lit("")), F.get("_gaps", j)))
        last = F.least(i + over, F.size("_all") - 1)
        right = F.transform(F.sequence(i, last), lambda j: F.concat(F.get("_gaps", j + 1), F.when(j < last, F.get("_all", j + 1)).otherwise(F.lit(""))))
        before, after = F.array_join(left, ""), F.array_join(right, "")
        return F.struct(i.alias("_at"), F.length(F.get("_gaps", i)).cast("long").alias("_skip"), F.get("_all", i).alias("candidate"), F.when(F.length(before) > REACH, F.substring(before, -REACH, REACH)).otherwise(before).alias("before"), F.substring(after, 1, REACH).alias("after"))

    each = gaps.select(key, "_row", F.explode(F.transform(F.sequence(F.lit(0), F.size("_all") - 1), piece)).alias("_c"))
    return each.select(key, "_row", "_c.*")


def scan(docs: DataFrame, findings: DataFrame | None = None, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """A row for each different candidate of each row of `docs`: `key`, candidate, times, before, after, probability, is_secret, spans.

    Every occurrence is judged in its own context; probability, before and after are of the most probable one, the
    first of equals; spans has the start (from 0) and end of each, in characters. `findings` are labelled findings,
    those of labelled_findings() by default. Rows without candidates (null and empty texts among them) give none,
    repeated rows give theirs each. Only candidates are shuffled, by row.
    """
    from pyspark.ml.functions import vector_to_array

    model = train(labelled_findings(docs.sparkSession) if findings is None else findings)
    rows = candidates(docs, text, key).withColumns(features())
    scored = model.transform(rows).withColumn("probability", F.round(F.element_at(vector_to_array("probability"), 2), 6))
    end = F.sum(F.col("_skip") + F.length("candidate")).over(Window.partitionBy("_row").orderBy("_at"))
    placed = scored.select(key, "_row", "_at", "candidate", "before", "after", "probability", end.alias("_end"))
    span = F.struct((F.col("_end") - F.length("candidate")).alias("start"), F.col("_end").alias("end"))
    best = F.max_by(F.struct("before", "after", "probability"), F.struct("probability", -F.col("_at")))
    judged = placed.groupBy("_row", "candidate").agg(F.first(key).alias(key), F.count("*").alias("times"), best.alias("_best"), F.sort_array(F.collect_list(span)).alias("spans"))
    return judged.select(key, "candidate", "times", "_best.*", "spans").select(key, "candidate", "times", "before", "after", "probability", (F.col("probability") >= threshold).alias("is_secret"), "spans")
