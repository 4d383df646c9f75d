"""Secret scans: regular-expression candidates, false positives removed by a random forest.

Candidates are token-like strings with a digit, values assigned to a credential's name, and keys of
known forms, found by SQL functions in whole texts. A forest judges them by length, character
classes and transitions, coverage by the corpus's own dictionary, path shape and the words on both
sides. It is trained on labelled findings. Everything here is DataFrame functions and Spark's own
forest; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Names of credentials (as the end of a name), and names that announce other things.
CREDENTIAL = "password|passwd|pwd|passphrase|secret|token|key|auth|authorization|bearer|credential|credentials"
OTHERS = "sha|md5|hash|digest|checksum|commit|revision|etag|uuid|guid|id|version|release|build|isbn|phone|tel|fax|order|invoice|ticket|url|uri|path|file|host|mail|email|date|time|page"
#: Token-like strings: 12 signs or more with a digit. The look-behind makes them start where a token starts, so a long run is read once.
SIGN = r"A-Za-z0-9+/_.@\-"
TOKEN = rf"(?<![{SIGN}])(?=[A-Za-z+/_.@\-]*+[0-9])[{SIGN}]{{12,}}"
#: Values of any length that a credential's name is given or that follow the word bearer, keys of known forms (no digit
#: needed), and private keys with whatever headers they have. Every run of signs is possessive, so texts are read in linear time.
VALUE = r"\"[^\"\n]{4,}+\"|'[^'\n]{4,}+'|[^\s\"'<>,;()\[\]{}]{4,}+"
NAMED = r"(?i:passw(?:or)?d|pwd|passphrase|secret|token|key|auth|authorization|bearer|credentials?)[\"']?\s{0,2}[:=]\s{0,2}(?:(?i:bearer|basic|token)\s{1,2})?"
ASSIGNED = rf"(?:{NAMED}|(?<![A-Za-z])(?i:bearer)\s{{1,2}}(?=[A-Za-z0-9._~+/\-]{{12}}))({VALUE})"
BLOCK = r"PRIVATE KEY(?: BLOCK)?-----"
KNOWN = rf"-----BEGIN [A-Z0-9 ]{{0,24}}{BLOCK}[^\-]*+(?:-(?!----)[^\-]*+)*+-----END [A-Z0-9 ]{{0,24}}{BLOCK}|(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{{16}}(?![A-Za-z0-9])"
FEATURES = [
    "length", "digits", "uppers", "lowers", "marks", "runs", "switches", "cases", "kinds", "hexes", "likely", "coverage", "path", "dots", "named", "other", "assigned",
    "nearby", "between",
]


def _share(column: str, letters: str) -> Column:
    return F.length(F.regexp_replace(column, f"[^{letters}]", "")) / F.length(column)


def _hits(rows: DataFrame, pattern: str, kind: int) -> DataFrame:
    """key, doc_id, kind, nth, hit, gap (signs before it since the last one), and the text on both sides, of every match of a pattern in rows(key, doc_id, text)."""
    gaps = F.transform(F.split("text", pattern, -1), lambda s: F.struct(F.length(s).alias("n"), F.substring(s, 1, 40).alias("head"), F.substring(s, -60, 60).alias("tail")))
    found = rows.select("key", "doc_id", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hits"), gaps.alias("gaps")).filter(F.size("hits") > 0)
    zipped = F.arrays_zip("hits", "gaps", F.slice("gaps", 2, F.size("hits")).alias("after"))
    each = found.select("key", "doc_id", F.lit(kind).alias("kind"), F.posexplode(F.slice(zipped, 1, F.size("hits"))).alias("nth", "f"))
    return each.select("key", "doc_id", "kind", "nth", F.col("f.hits").alias("hit"), F.col("f.gaps.n").alias("gap"), F.col("f.gaps.tail").alias("tail"), F.col("f.after.head").alias("head"))


def candidates(docs: DataFrame) -> DataFrame:
    """Findings of docs(doc_id, text): doc_id, row, key, nth, start, secret, before, assigned, earlier, after.

    start counts code points from 0; repeated strings are findings of their own; one inside another
    is left out. before is the word in front (a name, if assigned), earlier the one before that, after
    the next one, all lower case. key is xxhash64(doc_id, text); rows of equal doc_id and text have the same
    findings, each row with its own `row`, a hash of key and the copy's number, so a task that is run again gives
    the same rows. Null and empty texts have none."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").withColumn("key", F.xxhash64("doc_id", "text"))
    every = _hits(rows.filter(F.col("text").rlike("[0-9]")), TOKEN, 0).unionByName(_hits(rows, f"{KNOWN}|{ASSIGNED}", 1))
    met = every.repartition(common.partitions(docs.sparkSession), "key").groupBy("key", "doc_id", "kind", "nth")
    once = met.agg(F.count("*").alias("copies"), F.first("hit").alias("hit"), F.first("gap").alias("gap"), F.first("tail").alias("tail"), F.first("head").alias("head"))
    run = Window.partitionBy("key", "doc_id", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    ended = once.withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(run)).filter((F.col("kind") == 1) | F.col("hit").rlike("[A-Za-z]"))
    known = F.col("hit").rlike(f"^(?:{KNOWN})$") & (F.col("kind") == 1)
    value = F.regexp_extract("hit", f"^{ASSIGNED}$", 1)
    quoted = (F.col("kind") == 1) & ~known & value.rlike("^[\"']")
    bare = F.when((F.col("kind") == 0) | known, F.col("hit")).when(quoted, value.substr(F.lit(2), F.length(value) - 2)).otherwise(value)
    both = ended.withColumn("secret", bare).withColumn("quoted", quoted.cast("int")).withColumn("end", F.col("end") - F.col("quoted"))
    lead = F.concat("tail", F.when(F.col("kind") == 1, F.expr("substring(hit, 1, length(hit) - length(secret) - quoted)")).otherwise(""))
    both = both.withColumn("lead", lead).withColumn("start", (F.col("end") - F.length("secret")).cast("long"))
    order = Window.partitionBy("key", "doc_id").orderBy("start", F.desc("end"), "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = both.withColumn("reach", F.coalesce(reach, F.lit(0))).filter(F.col("start") >= F.col("reach")).withColumn("nth", F.row_number().over(order) - 1)
    each = apart.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).withColumn("row", F.xxhash64("key", "copy"))
    lead = F.col("lead")
    name = F.lower(F.regexp_extract(lead, r"([A-Za-z_][A-Za-z0-9_\-]*)[^A-Za-z0-9]{0,6}$", 1))
    assigned = lead.rlike(r"[A-Za-z0-9_\-][\"']?\s{0,2}[:=]\s{0,2}[\"']?$")
    earlier = F.lower(F.regexp_extract(lead, r"([A-Za-z_]+)[^A-Za-z_]+[A-Za-z_][A-Za-z0-9_\-]*[^A-Za-z0-9]{0,6}$", 1))
    return each.select("doc_id", "row", "key", "nth", "start", "secret", name.alias("before"), assigned.alias("assigned"), earlier.alias("earlier"), F.lower(F.regexp_extract("head", r"^[^A-Za-z]{0,4}([A-Za-z]+)", 1)).alias("after"))


def dictionary(docs: DataFrame, share: float = 0.98) -> DataFrame:
    """word, n: free-standing runs of four letters or more of docs, lower case; the most frequent ones that make up `share` of all such runs.

    Letters inside a token don't count, so keys bring no words, and the bound follows the corpus's size."""
    alone = rf"(?<![{SIGN}])[A-Za-z]{{4,}}(?![{SIGN}])"
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(alone), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    words = common.written(words.groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n")), "words")
    sizes = words.groupBy(F.floor(F.log2("n") * 4).alias("size")).agg(F.sum("n").alias("n"), F.min("n").alias("least")).orderBy(F.desc("size")).collect()  # a few hundred rows
    total, run, least = sum(r["n"] for r in sizes), 0, 1
    for r in sizes:
        least, run = r["least"], run + r["n"]
        if run >= share * total:
            break
    return words.filter(F.col("n") >= least)


def transitions(words: DataFrame) -> DataFrame:
    """pair, bits: how many bits each letter takes after another one in words(word, n); 676 rows at most."""
    pairs = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("pair"))
    sums = pairs.groupBy("pair").agg(F.sum("n").cast("double").alias("n"))
    of = Window.partitionBy(F.substring("pair", 1, 1))
    return sums.select("pair", (-F.log2((F.col("n") + 0.5) / (F.sum("n").over(of) + 13))).alias("bits"))


def features(found: DataFrame, words: DataFrame, pairs: dict[str, float]) -> DataFrame:
    """found with FEATURES, all doubles. The dictionary is joined with the distinct secrets' letter runs."""
    parts = found.select("secret").distinct().select("secret", F.explode(F.regexp_extract_all(F.lower("secret"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    known = parts.join(words.select("word"), "word").groupBy("secret").agg(F.sum(F.length("word")).alias("covered"))
    out = found.join(known, "secret", "left")
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]) if pairs else F.expr("cast(map() as map<string, double>)")
    low = F.lower("secret")
    letters = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length("secret") - 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(2))), lambda p: p.rlike("^[a-z]{2}$"))
    bits = F.aggregate(letters, F.lit(0.0), lambda a, p: a + F.coalesce(F.try_element_at(table, p), F.lit(12.0)))
    credential, other = rf"(?:{CREDENTIAL})s?$", rf"(?:^|[_\-])(?:{OTHERS})[0-9]*$"
    per = F.length("secret")
    numbers = {
        "length": per, "digits": _share("secret", "0-9"), "uppers": _share("secret", "A-Z"), "lowers": _share("secret", "a-z"),
        "marks": 1 - _share("secret", "A-Za-z0-9"),
        "runs": F.regexp_count("secret", F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")) / per,
        "switches": F.regexp_count("secret", F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")) / per,
        "cases": F.regexp_count("secret", F.lit("[a-z](?=[A-Z])|[A-Z](?=[a-z])")) / per,
        "kinds": F.size(F.array_distinct(F.split("secret", ""))) / per,
        "hexes": _share("secret", "0-9a-fA-F"), "likely": F.when(F.size(letters) > 0, bits / F.size(letters)).otherwise(6.0), "coverage": F.coalesce(F.col("covered"), F.lit(0)) / per,
        "path": F.regexp_count("secret", F.lit("[A-Za-z0-9]/[A-Za-z0-9]")) / per, "dots": F.regexp_count("secret", F.lit(r"@|[A-Za-z0-9]\.[A-Za-z0-9]")) / per,
        "named": F.col("before").rlike(credential), "other": F.col("before").rlike(other), "assigned": F.col("assigned"),
        "nearby": F.col("earlier").rlike(credential) | F.col("after").rlike(credential), "between": (F.length("before") > 0) & (F.length("after") > 0) & ~F.col("assigned"),
    }
    return out.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in numbers.items()}).drop("covered")


# -- labelled findings ------------------------------------------------------------------------

#: Words in made findings.
WORDS = ("house", "water", "system", "light", "report", "little", "market", "number", "school", "window", "garden", "paper", "letter", "music", "river", "stone", "table", "summer", "winter", "forest")
_VOWELS = "aaaaeeeeeiiiooou"


def made_findings(spark: SparkSession, n: int = 5000, seed: str = "train") -> DataFrame:
    """n labelled findings with the columns of candidates(): half of them secrets of many forms, half what resembles them.

    The label follows from how a string was made, not from any rule over its features. They stand in for
    reviewers' findings where a user has none; every string comes from a hash of its number and the seed."""
    a, b = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256), F.sha2(F.concat(F.lit("b" + seed), F.col("id").cast("string")), 256)
    base = spark.range(0, n, 1, 4).select("id", a.alias("a"), b.alias("b"))

    def pick(items, k: int) -> Column:
        return F.element_at(F.array(*map(F.lit, items)), (F.conv(F.substring("b", k, 4), 16, 10).cast("int") % len(items) + 1).cast("int"))

    dice = lambda k: F.conv(F.substring("b", k, 4), 16, 10).cast("int") / 65536
    number = lambda k, size: F.substring(F.conv(F.substring("a", k, 12), 16, 10), 1, size)
    mixed = F.concat(*[F.base64(F.unhex(F.sha2(F.concat(c, F.lit(x)), 256))) for c, x in (("a", "1"), ("b", "2"))])
    plain = F.regexp_replace(mixed, "[+/=]", "")
    letters = F.regexp_replace(mixed, "[^A-Za-z]", "")
    upper = F.translate(F.substring("a", 1, 40), "0123456789abcdef", "K7QZ2XWM5HTRJ3PV")
    size = (dice(5) * 32).cast("int") + 16
    word, word2, word3 = pick(WORDS, 9), pick(WORDS, 13), pick(WORDS, 17)
    secrets = [
        F.concat(pick(("AKIA", "ASIA"), 21), F.substring(upper, 1, 16)), F.concat("a", "b").substr(F.lit(1), size), F.concat("a", "b").substr(F.lit(1), size),
        mixed.substr(F.lit(1), size + 4), plain.substr(F.lit(1), size), F.concat(pick(("ghp_", "glpat-", "xoxb-", "sk_live_", "hf_"), 21), plain.substr(F.lit(1), size + 8)),
        F.concat(F.lit("eyJ"), plain.substr(F.lit(1), size), F.lit("."), plain.substr(F.lit(30), size), F.lit("."), plain.substr(F.lit(9), size)),
        F.concat(plain.substr(F.lit(1), (dice(25) * 6).cast("int") + 5), pick(("!", "#", "$", "%", "&", "*"), 21), plain.substr(F.lit(20), (dice(29) * 6).cast("int") + 2)),
        upper.substr(F.lit(1), size), F.concat(word, pick(("-", "_", "!", "."), 21), number(1, 4), plain.substr(F.lit(1), (dice(25) * 8).cast("int") + 8)),
        letters.substr(F.lit(1), size), F.concat(letters.substr(F.lit(1), (dice(25) * 3).cast("int") + 2), number(1, 3), letters.substr(F.lit(9), (dice(29) * 3).cast("int"))),
        F.concat(F.lit("-----BEGIN "), pick(("", "RSA ", "EC ", "ENCRYPTED "), 21), F.lit("PRIVATE KEY-----\n"), F.when(dice(25) < 0.4, F.concat(F.lit("Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,"), F.upper(F.substring("a", 1, 32)), F.lit("\n\n"))).otherwise(""),
                 F.array_join(F.transform(F.sequence(F.lit(1), (dice(29) * 20).cast("int") + 1), lambda i: F.base64(F.unhex(F.sha2(F.concat("a", i.cast("string")), 384)))), "\n"), F.lit("\n-----END PRIVATE KEY-----")),
    ]
    others = [
        F.concat("a", "b").substr(F.lit(1), pick((32, 40, 64), 21)),
        F.concat_ws("-", F.substring("a", 1, 8), F.substring("a", 9, 4), F.substring("a", 13, 4), F.substring("a", 17, 4), F.substring("a", 21, 12)),
        F.concat(word, F.lit("."), number(1, 2), F.lit("@"), pick(("mail", "post", "web"), 21), number(3, 1), F.lit(".example."), pick(("com", "org", "net"), 25)),
        F.concat(word, F.lit("/"), word2, number(1, 3), F.lit("/"), word3, pick((".html", ".txt", ".py", "/index.12"), 21)),
        F.concat(F.lit("www."), word, number(1, 3), F.lit("."), word2, pick((".com", ".org/", ".net/a1"), 21)),
        F.concat(F.lit("v"), number(1, 1), F.lit("."), number(2, 2), F.lit("."), number(4, 2), pick(("-beta.", "-rc.", "-alpha"), 21), number(7, 1)),
        F.concat(F.lit("20"), number(1, 2), F.lit("-0"), number(3, 1), F.lit("-1"), number(5, 1), F.lit("T0"), number(7, 1)),
        F.concat(word, F.lit("_"), word2, F.lit("_"), number(1, 3)), F.concat(F.initcap(word), F.initcap(word2), F.initcap(word3), number(1, 2)),
        F.concat(word, pick(("", " ", "-"), 21), word2), F.concat(F.upper(F.substring(word, 1, 3)), F.lit("-"), number(1, 5), F.lit("-"), F.upper(F.substring(word2, 1, 2)), F.lit("-"), number(7, 2)),
        F.concat(F.lit("+1-555-"), number(1, 3), F.lit("-"), number(5, 4), F.lit("x"), number(9, 2)), word,
        F.concat(*[F.translate(F.substring(c, k, 1), "0123456789abcdef", x) for c, k, x in (("a", 1, "bdfgklmnprstvzhc"), ("a", 2, _VOWELS), ("a", 3, "lmnrstdkpbgvfczh"), ("a", 4, _VOWELS), ("b", 61, "nnnrrrssstttllmd"))],
                 F.when(dice(25) < 0.5, F.concat(F.translate(F.substring("b", 62, 1), "0123456789abcdef", _VOWELS), F.translate(F.substring("b", 63, 1), "0123456789abcdef", "nnnrrrssstttllmd"))).otherwise("")),
    ]
    form = lambda forms: F.element_at(F.array(*forms), (F.floor(F.col("id") / 2) % len(forms) + 1).cast("int"))
    label = (F.col("id") % 2).cast("double")
    names = pick(("password", "db_password", "passwd", "api_key", "aws_secret_access_key", "client_secret", "token", "access_token", "secret", "auth", "authorization", "bearer", "key", "credentials"), 33)
    beside = pick(("sha256", "md5", "commit", "checksum", "id", "uuid", "request_id", "version", "url", "path", "file", "mail", "order", "date"), 33)
    form_of_other = F.floor(F.col("id") / 2) % len(others)
    named = F.when(label == 1, dice(37) < 0.75).otherwise(F.when(form_of_other.isin(9, 12, 13), True).when(form_of_other < 2, False).otherwise(dice(37) < 0.15))
    about = F.when(label == 1, False).otherwise(dice(41) < F.when(form_of_other < 2, 0.9).otherwise(0.4))
    assigned = F.when(named | about, dice(45) < 0.9).otherwise(dice(45) < 0.05)
    # A key that nothing announces shows itself by its form only if it isn't a bare run of hex digits.
    secret = F.when(label == 1, F.when(named, form(secrets)).otherwise(form([s for i, s in enumerate(secrets) if i not in (1, 2, 7, 10, 11)]))).otherwise(form(others))
    return base.select(
        F.lit(None).cast("long").alias("doc_id"), F.col("id").alias("row"), F.col("id").alias("key"), F.lit(0).alias("nth"), F.lit(0).cast("long").alias("start"), secret.alias("secret"),
        F.when(named, names).when(about, beside).otherwise(F.when(dice(49) < 0.85, word2).otherwise("")).alias("before"), assigned.alias("assigned"),
        F.when(dice(53) < 0.8, word3).otherwise("").alias("earlier"), F.when(dice(57) < 0.7, word).otherwise("").alias("after"), label.alias("label"))


def train(labelled: DataFrame, most: int = 20_000, trees: int = 40, depth: int = 9, seed: int = 7):
    """A forest over FEATURES from rows with a label; None if only one label (or none) is there.

    most: the bound of the training sample, about so many rows of each label, taken by a hash."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    known = common.written(labelled.filter(F.col("label").isNotNull()).select(*FEATURES, "label", "secret", "row", "nth"), "labels")
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(n) < 2:
        return None
    share = F.when(F.col("label") == 1, most / n[1.0]).otherwise(most / n[0.0])
    sample = known.filter(F.pmod(F.xxhash64("secret", "row", "nth"), F.lit(1 << 20)) < share * (1 << 20))
    weight = F.when(F.col("label") == 1, 0.5 / n[1.0]).otherwise(0.5 / n[0.0]) * sum(n.values())
    taken = common.written(sample.select(*FEATURES, "label", weight.alias("weight")), "labelled")  # the forest reads it once a level
    rows = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(taken).select("vector", "label", "weight")
    return RandomForestClassifier(featuresCol="vector", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def score(found: DataFrame, model) -> DataFrame:
    """found with score (the forest's probability of a secret) and is_secret (score of a half or more).

    Without a model every row has the score 0.5."""
    if model is None:
        return found.withColumn("score", F.lit(0.5)).withColumn("is_secret", F.lit(True))
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(found))
    judged = rows.withColumn("score", vector_to_array("probability")[1]).drop("vector", "rawPrediction", "probability", "prediction")
    return judged.withColumn("is_secret", F.col("score") >= 0.5)


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """All findings of docs with score and is_secret.

    labelled: findings with the columns of candidates() and a label (1.0 for a secret); without it, made_findings()."""
    spark = docs.sparkSession
    words = common.written(dictionary(docs), "dictionary")
    pairs = {r["pair"]: r["bits"] for r in transitions(words).collect()}
    found = common.written(features(common.written(candidates(docs), "findings"), words, pairs), "features")
    own = spark.createDataFrame([(w,) for w in WORDS], "word string")
    known = made_findings(spark) if labelled is None else labelled
    return score(found, train(features(known, words.select("word").union(own).distinct(), pairs)))


def redact(docs: DataFrame, mark: str = "[SECRET]", labelled: DataFrame | None = None) -> DataFrame:
    """docs with every secret replaced by `mark`, all columns kept, n_chars (if there) counted anew.

    A string that is a secret in one place of a text goes everywhere in it. Rows without secrets,
    null texts too, stay as they are; rows without doc_id are cleaned like others."""
    found = scan(docs, labelled).filter("is_secret").groupBy(F.col("key").alias("__key"), F.col("doc_id").alias("__id"))
    secrets = found.agg(F.array_sort(F.collect_set(F.struct((-F.length("secret")).alias("n"), "secret"))).alias("__secrets"))
    names = docs.columns
    own = F.col("doc_id").cast("long")
    joined = docs.join(secrets, (F.xxhash64(own, F.col("text")) == F.col("__key")) & own.eqNullSafe(F.col("__id")), "left")
    clean = F.aggregate("__secrets", F.col("text"), lambda t, s: F.replace(t, s["secret"], F.lit(mark)))
    out = joined.withColumn("text", F.when(F.col("__secrets").isNotNull(), clean).otherwise(F.col("text")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("__secrets").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in names])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, nth, start, length, before, secret_sha256, score, is_secret of every finding."""
    return scan(docs).select("doc_id", "nth", "start", F.length("secret").alias("length"), "before", F.sha2(F.col("secret").cast("binary"), 256).alias("secret_sha256"), "score", "is_secret")
