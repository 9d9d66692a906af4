"""Secret scans: candidate strings judged by a random forest over built-in features (no Python on the executors)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketwise.llm.tables import materialize, smallest_hashes

CANDIDATE = r"[A-Za-z0-9+/_.\-]{16,}"
TRIMMED = r"^[./\-]+|[./\-]+$"
LONG = 16
# names, or parts of names, that introduce a credential; the short ones only as whole parts
KEYWORD = (r"(?:token|secret|password|passwd|api[_\-]?key|access[_\-]?key|private[_\-]?key"
           r"|(?:secret|signing|encryption|master|account)[_\-]?key|credential|authorization"
           r"|(?<![a-z])(?:pwd|pass|auth|bearer|key))s?(?![a-z])")
NAME = r"[a-z0-9_.\-]{0,60}" + KEYWORD + r"[a-z0-9_.\-]{0,60}"
SIGN = r"(?:=>|:=|==|=|:)"
# name=value, "name":"value" and the like inside one word; a name with its sign at the end of a word
VALUE = r"[^\s\"'`<>,;=(){}\[\]]+"
INSIDE = rf"(?i)(?:^|[^a-z0-9]){NAME}[\"'`]?{SIGN}[\"'`]?({VALUE})"
NAMED = rf"(?i)(?:^|[^a-z0-9]){NAME}[\"'`]?\s?{SIGN}[\"'`]?$"
ANY_NAMED = rf"(?i){KEYWORD}[a-z0-9_.\-]{{0,60}}[\"'`]?\s?[=:]"
# scheme://user:password@host
LOGIN = r"[A-Za-z][A-Za-z0-9+.\-]{0,20}://[^\s/:@]*:([^\s/@]+)@"
# words of the body of a private key block
BODY = r"^[A-Za-z0-9+/]+=*$"
# published forms of keys of large services, signed tokens
FORMAT = (r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_\-]{20,}"
          r"|xox[abeoprs]-[A-Za-z0-9\-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{35}|npm_[A-Za-z0-9]{36}"
          r"|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}|eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]*)?)$")
# neighbouring words that name a checksum, a revision or another public identifier, as whole parts of a name
PUBLIC = (r"(?<![a-z0-9])(?:commit|revision|sha-?[0-9]{0,3}|sha[0-9]{1,3}sum|md5|md5sum|checksum|digest"
          r"|(?<!pass[_\-])(?<!password[_\-])hash|etag|fingerprint|uuid|guid)(?:e?s)?(?![a-z0-9])")
# stand-ins that documentation shows instead of a value
STAND_IN = (r"(?i)example|sample|dummy|placeholder|change_?-?me|change_?-?this|your[_\-]|[_\-]here|redacted|x{4,}|\*{3,}"
            r"|^\$|^%.*%$|^<.*>$|^\[.*\]$|^\{.*\}$|^(?:0?1234567|abcdef|qwerty)|(.)\1{5,}")
FEATURES = ("length", "transitions", "digit_share", "upper_share", "hex_only", "digits_only", "variety",
            "consonant_runs", "dictionary", "path_parts", "dots", "extension", "web_before", "keyword_near",
            "assigned", "quoted", "plain_words_near", "known_format", "login", "pem_block",
            "public_near", "stand_in")


@dataclass(frozen=True)
class SecretSpec:
    """``per_label`` labelled findings of each kind at most (smallest hash) train ``trees`` trees of ``depth``.

    A dictionary word stands, outside candidates, in at least the share ``known_share`` of the distinct texts.
    """

    per_label: int = 2000
    trees: int = 24
    depth: int = 5
    known_share: float = 0.001
    seed: int = 7
    least: float = 0.5


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, word_no, part, secret`` and the context of every candidate string of whole texts.

    A candidate is a run of 16 or more characters that keys are made of, inside one word (between white space) and
    without punctuation at its ends ('=' ends a run, so a name is no part of its value); a value of any length and
    alphabet that a name with a keyword assigns, in the same word or the next; the password of a URL; and every
    word of a private key block. ``part`` numbers the runs of a word, then its other values.
    """
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = base.select(
        "doc_id", F.split("text", r"\s+").alias("w"), F.col("text").rlike(ANY_NAMED).alias("naming"),
        (F.col("text").contains("://") & F.col("text").rlike(LOGIN)).alias("logins"), F.col("text").contains("-----BEGIN").alias("blocks"))
    # last words of the first line of private key blocks, and the words that close a block
    none = F.array().cast("array<int>")
    w = F.col("w")
    at_words = lambda test: F.filter(F.transform(w, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull())
    head = lambda i: F.array_join(F.slice(w, F.greatest(i - 3, F.lit(1)), F.least(i + 1, F.lit(5))), " ")
    words = words.withColumn("opens", F.when(F.col("blocks"), at_words(
        lambda x, i: x.endswith("-----") & head(i).rlike(r"-----BEGIN (?:\S+ )*PRIVATE KEY(?: BLOCK)?-----$"))).otherwise(none))
    words = words.withColumn("closes", F.when(F.size("opens") > 0, at_words(
        lambda x, i: x.startswith("-----END"))).otherwise(none))

    def in_block(i):
        opened = F.array_max(F.filter("opens", lambda p: p < i))
        closed = F.array_max(F.filter("closes", lambda p: p <= i))
        return opened.isNotNull() & (closed.isNull() | (closed < opened))

    two_before = lambda i: F.array_join(F.slice(w, F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))), " ")
    named = lambda i: F.when(F.col("naming") & (i > 0), two_before(i).rlike(NAMED)).otherwise(F.lit(False))
    wanted = lambda x, i: ((F.length(x) >= LONG) | (F.col("naming") & (x.rlike(INSIDE) | named(i)))
                           | (F.col("logins") & x.rlike(LOGIN)) | ((F.size("opens") > 0) & x.rlike(BODY) & in_block(i)))
    special = F.col("naming") | F.col("logins") | (F.size("opens") > 0)
    spots = F.when(special, at_words(wanted)).otherwise(at_words(lambda x, i: F.length(x) >= LONG))
    at = words.select("*", F.explode(spots).alias("i"))
    near = at.select(
        "doc_id", F.col("i").cast("long").alias("word_no"), F.col("w")[F.col("i")].alias("word"),
        F.lower(F.array_join(F.slice("w", F.greatest(F.col("i") - 2, F.lit(1)), F.least(F.col("i"), F.lit(3))), " "))
        .alias("before"),
        F.lower(F.coalesce(F.get("w", F.col("i") + 1), F.lit(""))).alias("after"),
        named(F.col("i")).alias("named"), F.when(F.size("opens") > 0, F.col("w")[F.col("i")].rlike(BODY) & in_block(F.col("i"))).otherwise(F.lit(False))
        .alias("block"))
    near = near.withColumn("before", F.when(F.col("word_no") > 0, F.col("before")).otherwise(F.lit("")))
    empty = F.array().cast("array<string>")
    runs = F.filter(F.transform(F.regexp_extract_all("word", F.lit(f"({CANDIDATE})"), 1),
                                lambda x: F.regexp_replace(x, TRIMMED, "")), lambda x: F.length(x) >= LONG)
    held = F.transform(F.regexp_extract_all("word", F.lit(INSIDE), 1), lambda x: F.regexp_replace(x, r"[.:!?]+$", ""))
    logins = F.regexp_extract_all("word", F.lit(LOGIN), 1)
    whole = F.regexp_replace(F.regexp_replace("word", r"^[\"'`(<\[{]+", ""), r"[\"'`)>\]},;.:!?]+$", "")
    # a quoted value ends at its quote, whatever follows in the word
    inside = F.regexp_extract("word", r"^[(<\[{]*([\"'`])(.+?)\1", 2)
    whole = F.when(inside != "", inside).otherwise(whole)
    others = F.concat(held, logins, F.when(F.col("named"), F.array(whole)).otherwise(empty),
                      F.when(F.col("block"), F.array(F.regexp_replace("word", "=+$", ""))).otherwise(empty))
    near = near.select("*", runs.alias("runs"), logins.alias("passwords"), others.alias("others"))
    # a value that is one of the runs but for punctuation at its ends is that run
    more = F.filter(F.array_distinct("others"), lambda x: (F.length(x) > 0) & ~F.array_contains(
        F.col("runs"), F.regexp_replace(F.regexp_replace(x, TRIMMED, ""), "=+$", "")))
    found = near.select("*", F.posexplode(F.concat("runs", more)).alias("part", "secret"))
    return found.drop("runs", "others")


def _share(secret: Column, kind: str) -> Column:
    return F.length(F.regexp_replace(secret, f"[^{kind}]+", "")) / F.length(secret)


def _shaped(found: DataFrame) -> DataFrame:
    """Candidates with those of ``FEATURES`` that their own characters, words and neighbours give."""
    s, before = F.col("secret"), F.col("before")
    one = lambda c: c.cast("double")
    last = F.regexp_replace(F.regexp_replace(before, r"[\"'=:\s]+$", ""), r"^.*[\s\"'=:]", "")
    inner = F.regexp_replace(F.expr("substring(word, 1, greatest(locate(secret, word) - 1, 0))"), r"[./\-]+$", "")
    told = F.lower(F.regexp_replace(inner, r"[\"'`=:>({\[]+$", ""))
    name = F.when(told == "", last).otherwise(told)
    word_at = F.col("word")
    return found.select(
        "doc_id", "word_no", "part", "secret",
        one(F.length(s)).alias("length"),
        ((F.size(F.split(s, r"(?<=[0-9])(?=[^0-9])|(?<=[A-Z])(?=[^A-Z])|(?<=[a-z])(?=[^a-z])")) - 1)
         / F.length(s)).alias("transitions"),
        _share(s, "0-9").alias("digit_share"), _share(s, "A-Z").alias("upper_share"),
        one(s.rlike(r"^([0-9a-f]+|[0-9A-F]+)$")).alias("hex_only"), one(s.rlike(r"^[0-9.\-]+$")).alias("digits_only"),
        (F.size(F.array_distinct(F.split(s, ""))) / F.length(s)).alias("variety"),
        (F.size(F.regexp_extract_all(F.lower(s), F.lit(r"([bcdfghjklmnpqrstvwxz]{4,})"), 1)) / F.length(s))
        .alias("consonant_runs"),
        one(F.size(F.split(s, "/")) - 1).alias("path_parts"), one(F.size(F.split(s, r"\.")) - 1).alias("dots"),
        one(s.rlike(r"\.[A-Za-z]{2,5}$")).alias("extension"), one(word_at.rlike(r"([\w.+\-]+@[\w\-]+[.]|://|www[.])")).alias("web_before"),
        one(name.rlike(NAME + "$")).alias("keyword_near"),
        one(before.rlike(r"([=:]|=>)[\"'`]?$") | inner.rlike(r"([=:]|=>)[\"'`]?$")).alias("assigned"),
        one(word_at.rlike(r"[\"'].*[\"']")).alias("quoted"),
        one(F.size(F.filter(F.split(F.concat_ws(" ", before, F.col("after")), " "),
                            lambda x: x.rlike(r"^\p{L}+[,.]?$")))).alias("plain_words_near"),
        one(s.rlike(FORMAT)).alias("known_format"), one(F.array_contains("passwords", s)).alias("login"),
        one(F.col("block")).alias("pem_block"),
        one(before.rlike(PUBLIC) | F.lower(inner).rlike(PUBLIC) | F.col("after").rlike(PUBLIC)).alias("public_near"),
        one(s.rlike(STAND_IN)).alias("stand_in"))


def featured(found: DataFrame, docs: DataFrame, spec: SecretSpec) -> DataFrame:
    """Candidates with the numeric columns ``FEATURES``.

    ``dictionary`` is the share of the candidate's letters in runs of three or more that the corpus uses as
    words: in a share of the distinct texts, outside candidates, so that neither copies of a text or key nor the
    size of the corpus make a key's runs known. Words are combined before the shuffle and meet only the distinct
    runs of the candidates. The texts are searched for candidates once: what their words and neighbours tell is
    stored as numbers, without the words themselves.
    """
    found = materialize(_shaped(found), "candidates")
    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    plain = F.lower(F.regexp_replace("text", CANDIDATE, " "))
    runs = F.filter(F.split(F.lower("secret"), r"[^\p{L}]+"), lambda x: F.length(x) >= 3)
    wanted = found.select(F.explode(runs).alias("word")).distinct()
    own = F.filter(F.array_distinct(F.split(plain, r"[^\p{L}]+")), lambda x: F.length(x) >= 3)
    # the empty word stands in every text and so counts the texts
    counts = materialize(texts.select(F.explode(F.array_append(own, F.lit(""))).alias("word"))
                         .groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    n_texts = counts.filter("word = ''").select(F.col("n").alias("n_texts"))  # one row
    often = counts.crossJoin(F.broadcast(n_texts)).filter(F.col("n") >= F.col("n_texts") * spec.known_share)
    known = wanted.join(often, "word", "left_semi")
    texts_of = found.select("secret").distinct()
    covered = (texts_of.select("secret", F.explode(runs).alias("word")).join(known, "word")
               .groupBy("secret").agg(F.sum(F.length("word")).alias("covered")))
    dictionary = (F.coalesce("covered", F.lit(0)) / F.length("secret")).alias("dictionary")
    rest = [dictionary if x == "dictionary" else F.col(x) for x in FEATURES]
    return found.join(covered, "secret", "left").select("doc_id", "word_no", "part", "secret", *rest)


def weak_labels(found: DataFrame) -> DataFrame:
    """Labelled findings where a team has none of its own: ``label`` 1, 0, or null if neither rule speaks.

    1: a published key format, a line of a private key block, the password of a URL, or a value of six or more
    characters that a keyword assigns, that mixes letters and digits, is no web address, file or stand-in
    and has no word for checksums or revisions next to it. 0: letters only (unless a keyword assigns them and
    they are no words), digits only, a web or mail address, dictionary words with nothing assigned, a stand-in, or
    hexadecimal digits next to a word for checksums or revisions that no keyword assigns. Published formats count
    whatever stands around them.
    """
    mixed = (F.col("digit_share") > 0.1) & (F.col("digit_share") < 0.9) & (F.col("web_before") == 0)
    named = (F.col("keyword_near") == 1) & (F.col("assigned") == 1)
    public = (F.col("public_near") == 1) | (F.col("stand_in") == 1)
    yes = certain() | (named & mixed & ~public & (F.col("extension") == 0) & (F.col("length") >= 6))
    no = (((F.col("digit_share") == 0) & ~(named & (F.col("dictionary") <= 0.5))) | (F.col("digits_only") == 1)
          | (F.col("web_before") == 1) | ((F.col("dictionary") > 0.5) & (F.col("assigned") == 0))
          | (F.col("stand_in") == 1) | ((F.col("public_near") == 1) & (F.col("hex_only") == 1) & ~named))
    return found.withColumn("label", F.when(yes, 1.0).when(no, 0.0))


def certain() -> Column:
    """What no forest takes back: published key formats, lines of private key blocks, passwords of URLs but stand-ins."""
    return (F.col("known_format") == 1) | (F.col("pem_block") == 1) | ((F.col("login") == 1) & (F.col("stand_in") == 0))


def train(labelled: DataFrame, spec: SecretSpec = SecretSpec()) -> RandomForestClassificationModel | None:
    """Fit on rows with ``FEATURES`` and ``label`` (0, 1; null rows are left out): ``spec.per_label`` rows of each
    label at most, those with the smallest hash. None if only one label occurs, since there is nothing to tell apart;
    :func:`judge` then goes by the rules alone."""
    rows = smallest_hashes(
        labelled.filter("label is not null"), "label", F.xxhash64("secret", "doc_id", "word_no"),
        ["secret", "doc_id", "word_no", "part"], spec.per_label).select(*FEATURES, "label", "place")
    rows = materialize(rows.orderBy("label", "place").coalesce(1), "labelled")
    if rows.select("label").distinct().count() < 2:
        return None
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=spec.trees, maxDepth=spec.depth, seed=spec.seed,
                                  featureSubsetStrategy="sqrt").fit(ready.select("features", "label"))


def judge(found: DataFrame, model: RandomForestClassificationModel | None, spec: SecretSpec = SecretSpec()) -> DataFrame:
    """Candidates with ``probability`` and ``is_secret``. Without a model the rules of :func:`weak_labels` decide: only
    what they label 1 is a secret (probability null)."""
    if model is None:
        ruled = weak_labels(found).withColumn("is_secret", F.coalesce(F.col("label") == 1, F.lit(False)))
        return ruled.withColumn("probability", F.lit(None).cast("double")).select(*found.columns, "probability", "is_secret")
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)
    scored = model.transform(ready).withColumn("probability", vector_to_array("probability")[1])
    return scored.withColumn("is_secret", F.col("probability") >= spec.least).drop(
        "features", "rawPrediction", "prediction")


def scan(docs: DataFrame, labelled: DataFrame | None = None, spec: SecretSpec = SecretSpec()) -> DataFrame:
    """Every candidate of every whole text with the verdict of the forest.

    Gives ``doc_id, word_no`` (place among the words between white space), ``part`` (within the word),
    ``secret``, the ``FEATURES``, ``probability`` and ``is_secret``. ``labelled`` holds findings with ``FEATURES``
    and ``label``; with them the forest decides alone, also against a keyword that assigns the value, and only what is
    :func:`certain` stays a secret whatever it says. Without them :func:`weak_labels` labels the findings themselves;
    then the forest has nothing to say against its own teacher: it judges what the rules leave open, and what
    they label 1 is a secret. Null and empty texts have no candidates; rows are independent, repeated rows give
    repeated findings; other columns are ignored; an empty table gives no rows.
    """
    found = materialize(featured(candidates(docs), docs, spec), "findings")
    if labelled is not None:
        judged = judge(found, train(labelled, spec), spec)
        return judged.withColumn("is_secret", F.col("is_secret") | certain())
    judged = weak_labels(judge(found, train(weak_labels(found), spec), spec))
    return judged.withColumn("is_secret", F.col("is_secret") | F.coalesce(F.col("label") == 1, F.lit(False))).drop("label")


def mask(docs: DataFrame, spec: SecretSpec = SecretSpec(), mark: str = "[secret]",
         labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with every confirmed secret replaced by ``mark`` in its document; ``n_chars``, if present, follows.

    ``labelled`` as in :func:`scan`. All rows and columns stay; a text without secrets is unchanged. Longer secrets are replaced first; those under
    16 characters only where no letter or digit touches them.
    """
    hits = (scan(docs, labelled, spec).filter("is_secret and doc_id is not null").select("doc_id", "secret").distinct()
            .groupBy(F.col("doc_id").alias("__doc"))
            .agg(F.sort_array(F.collect_list(F.struct(-F.length("secret"), "secret"))).alias("__secrets")))
    both = docs.join(hits, docs["doc_id"].cast("bigint") == hits["__doc"], "left")
    quoted = lambda x: F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")),
                                F.lit(r"\E(?![A-Za-z0-9])"))
    safe = F.lit(mark.replace("\\", r"\\").replace("$", r"\$"))
    text = F.aggregate("__secrets", F.col("text"), lambda t, x: F.when(
        F.length(x["secret"]) >= LONG, F.replace(t, x["secret"], F.lit(mark))).otherwise(
        F.regexp_replace(t, quoted(x["secret"]), safe)))
    text = F.when(F.col("__secrets").isNull(), F.col("text")).otherwise(text)
    out = both.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__secrets").isNull(), F.col("n_chars"))
                             .otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
