r"""Secret scan with a random forest against false positives (operator 1, DataFrame and Spark ML functions only).

Candidates are runs of 12 or more characters ``[A-Za-z0-9_/+.=-]`` that hold a digit, however far into the run, and runs of
any length, with or without digits, that a key word assigns (``password: ...``). A run without a digit that no key word
assigns is no candidate: nearly all such runs are words, and nothing but their letters would speak for them. Each is described by its length, its
character classes and the transitions between them, the share of it that dictionary words cover, its path, and the words and
signs beside it; a random forest trained from labelled findings gives the probability that it is a secret.

Labelled findings are a table (candidate, before, after, path, label). ``labelled_findings`` makes one from rules:
keys, tokens and passwords in assignments against digests, numbers, identifiers, paths, placeholders and long words, with a
fixed number of rows (``TRAINING_ROWS``), so that training costs the same at every corpus size. Any other table will do.

Plan: one scan finds the texts that have a candidate (a regular expression; most texts end there); of these, marks are put
around candidates and the text is split at them, so that a text of any length gives its candidates in one pass. Places come
from a running sum per text. Scoring is a JVM expression. Redaction joins spans to texts, by broadcast only if they are few.

Defined results: null or empty text has no candidates; of a text of any length all candidates are scored, each with the 64
characters before and the 32 after it as its neighbours; candidates of equal features get equal probabilities; rows are told apart by (doc_id, hash of the text), so a repeated row
is scanned once and its findings appear once, while redaction applies to every copy; null identifiers and paths are kept;
an empty table gives no findings; the control characters U+0001 and U+0002 count as blanks; further columns are ignored by
the scan and passed through by the redaction.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, hinted

_SIGNS = r"A-Za-z0-9_/+.=\-"
TRAINING_ROWS = 6000
THRESHOLD = 0.5
MASK = "[SECRET]"
#: Rows of spans up to which redaction broadcasts them (some tens of bytes each).
BROADCAST_ROWS = 100_000

KEY_WORDS = "pass(?:word|wd|phrase)?|pwd|token|secret|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|bearer|credentials?"
_VALUE = rf"[A-Za-z0-9_/+\-](?:[{_SIGNS}]*[A-Za-z0-9_/+=\-])?"
#: What leads to a value that a key word assigns: the rest of the key's name, a sign, a quote.
_ASSIGNED = rf"(?i:{KEY_WORDS})(?:s|[A-Z0-9_.\-][A-Za-z0-9_.\-]*+)?[\"']?[\x20\t]*+[=:]++>?[\x20\t]*+[\"']?(?:(?i:bearer|basic)[\x20\t]++)?"
#: What leads to a candidate, and the candidate: a long run with a digit anywhere, or a run of any kind that is assigned.
CANDIDATE = rf"((?<![{_SIGNS}])[=.]*+(?=[A-Za-z_/+.=\-]*+[0-9])(?=[A-Za-z0-9_/+\-][{_SIGNS}]{{10,}}[A-Za-z0-9_/+=\-])|{_ASSIGNED})({_VALUE})"
OTHER_WORDS = "commit|sha\\d*|md5|checksum|digest|hash|etag|uuid|guid|rev(?:ision)?|version|order|invoice|tracking|isbn|phone|tel|card|account|ref|id|number|no|build|see|file|path|url"
TEST_PATHS = "test|tests|spec|example|examples|sample|fixture|fixtures|mock|doc|docs|vendor|lock|dist"
DICTIONARY = (
    "the and for with from this that have will your about account action address admin after again align android api app apple archive array article asset async auth auto back base basic beta binary block "
    "board book border bottom build button cache call card center change channel check child class clean client close cloud code color column commit common config connect console content control copy core count "
    "create current custom data date debug default delete demo deploy design detail device docs document domain download draft edit element email empty enable end engine entry error event example export external "
    "field file filter final first fix folder font form format forward frame function future general get global graph green grid group handle hash head header health height help hidden history home host html icon "
    "image import index info input insert install internal item java join json key label large last layout left length level library license light line link linux list load local lock log login logo long loop "
    "main manager map market master match max media member memory menu message meta method min mobile mode model module month more mount move name native net network new news next node note null number object "
    "offset old online only open option order other output owner package page panel parent part password path pattern phone photo pixel place plain plan platform play plugin point policy port post power preview "
    "price print private process product profile project property proxy public query queue quick random range read record red region release remote remove render report request reset resource response result "
    "return right role root route row rule run safe sample save schema scope screen script search section secure select send server service session set setting share short show side sign simple single site size "
    "slot small social sort source space spec split stack stage star start state static status step stop storage store stream string style submit success super support switch system table target task team temp "
    "template test text theme thread thumb time title todo token tool top total track tree trigger type unit update upload user util value vendor version video view web white width window word work world year zone "
    "aber auch bild datei daten dass durch eine einen fehler haben herr ihre jahr kann karte leer liste mehr nach name nicht noch oder passwort schlüssel seite sich sind suche über werden wenn wird zeit zwischen "
    "avec cette clé comme dans date depuis deux donnée elle erreur être fichier jour leur liste mais même mot notre nous page passe plus pour sans site sont sous temps titre tout une utilisateur valeur vers vous "
    "años archivo bien cada clave como contraseña cuando datos desde donde entre error está este fecha hasta hora lista mucho nombre otro página para pero porque puede según sobre también tiempo todo usuario valor vida"
).split()


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(pattern), F.lit(pattern[1:])))


def features(rows: DataFrame, dictionary: list[str] = DICTIONARY) -> tuple[DataFrame, list[str]]:
    """``rows`` (candidate, before, after, path) with a column per feature, and their names. ``dictionary``: words of any language."""
    c = F.col("candidate")
    lower = "abcdefghijklmnopqrstuvwxyz"
    kinds = "".join("v" if x in "aeiou" else "c" for x in lower)
    shape = F.translate(c, lower + lower.upper() + "0123456789_/+.=-", kinds + "u" * 26 + "d" * 10 + "s" * 6)
    rows = rows.withColumns({"_shape": shape, "_n": F.length(c).cast("double"), "_before": F.lower(F.coalesce("before", F.lit(""))), "_after": F.coalesce("after", F.lit("")), "_path": F.lower(F.coalesce("path", F.lit("")))})
    s, n = F.col("_shape"), F.col("_n")
    dictionary = "(?:" + "|".join(sorted({w for w in dictionary if len(w) > 3}, key=lambda w: (-len(w), w))) + ")"
    share = lambda k: (n - F.length(F.replace(s, F.lit(k), F.lit("")))) / n
    pairs = {f"t_{a}{b}": _count(s, a + b) / n for a in "vcuds" for b in "vcuds"}
    flag = lambda text, pattern: F.regexp_like(text, F.lit(pattern)).cast("double")
    columns = {
        "f_length": F.log(n),
        **{f"f_share_{k}": share(k) for k in "vcuds"},
        **pairs,
        "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "f_hex": flag(c, "^[0-9a-f]+$"),
        "f_dictionary": 1 - F.length(F.regexp_replace(F.lower(c), dictionary, "")) / n,
        "f_prefix": flag(c, r"^(AKIA|ASIA|gh[pousr]_|glpat-|xox[abp]-|sk_(live|test)_|AIza|eyJ|npm_|SG\.)"),
        "f_assigned": flag(F.col("_before"), r"[=:]\s*[\"']?$"),
        "f_quoted": (flag(F.col("_before"), "[\"']$") * flag(F.col("_after"), "^[\"']")),
        "f_key_word": flag(F.col("_before"), rf"(?:^|[^a-z])[a-z_.-]*(?:{KEY_WORDS})[a-z_.\"'-]*\s*(?:is|=|:)?\s*[\"']?$") ,
        "f_own_key": flag(F.lower(c), rf"^[a-z_.-]*(?:{KEY_WORDS})="),
        "f_other_word": flag(F.col("_before"), rf"(?:^|[^a-z])(?:{OTHER_WORDS})[\s\"'#:=]*$"),
        "f_test_path": flag(F.col("_path"), rf"(?:^|[/._-])(?:{TEST_PATHS})(?:[/._-]|$)"),
        "f_placeholder": flag(F.lower(c), r"x{4}|example|placeholder|changeme|your|(.)\1{5}|12345678|dummy|sample"),
    }
    columns = {k if k.startswith("f_") else "f_" + k: v.cast("double") for k, v in columns.items()}
    return rows.withColumns(columns).drop("_shape", "_n", "_before", "_after", "_path"), list(columns)


def labelled_findings(spark: SparkSession, rows: int = TRAINING_ROWS, seed: int = 1) -> DataFrame:
    """candidate, before, after, path, label (1.0: a secret), made from rules and a hash of the row number."""
    r = lambda k, m: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(m)).cast("int")
    hexes = lambda k, n: F.substring(F.sha2(F.concat_ws("-", "id", F.lit(seed), F.lit(k)), 512), 1, n)
    b64 = lambda k, n: F.substring(F.regexp_replace(F.base64(F.unhex(hexes(k, 128))), "=", ""), 1, n)
    plain = lambda k, n: F.substring(F.regexp_replace(F.base64(F.unhex(hexes(k, 128))), r"[=+/]", "x"), 1, n)
    letters = lambda k, n: F.translate(plain(k, n), "0123456789", "gQkWzRmXpT")
    pick = lambda k, *xs: F.array(*(x if isinstance(x, Column) else F.lit(x) for x in xs))[r(k, len(xs))]
    syllable = lambda k: pick(k, "the", "ing", "tion", "er", "an", "est", "ble", "schein", "keit", "mente", "eaux", "ver", "con", "data", "set", "load", "test", "name")
    word = lambda k: F.concat(*(syllable(f"{k}{i}") for i in range(3)))
    digits = lambda k, n: F.lpad(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10**n)).cast("string"), n, "4")
    key = pick("key", "password", "token", "secret", "api_key", "auth_token", "access_key", "passwd", "client_secret", "db_password", "private_key", "credential")
    sep, quote = pick("sep", "=", " = ", ": ", ":", "="), pick("quote", '"', "'", "", "")
    secret = pick("kind", hexes("a", 40), hexes("b", 32), hexes("c", 18), hexes("c2", 64), b64("d", 40), plain("e", 24), plain("f", 16), F.concat(F.lit("AKIA"), F.upper(plain("g", 16))), F.concat(F.lit("ghp_"), plain("h", 36)), F.concat(F.lit("sk_live_"), plain("i", 24)), F.concat(F.substring(word("j"), 1, 9), digits("k", 4)), b64("sa", 8), plain("sb", 11), letters("sc", 20), letters("sd", 32))
    uuid = F.concat_ws("-", hexes("l", 8), hexes("m", 4), hexes("n", 4), hexes("o", 4), hexes("p", 12))
    harmless = [
        ("hash", pick("q", hexes("q1", 40), hexes("q2", 32), hexes("q3", 64), hexes("q4", 18)), pick("q5", "commit ", "sha256:", "md5 = ", "checksum: ", "digest=\"", "etag: \"", "revision ")),
        ("plain hash", pick("r", hexes("r1", 40), hexes("r2", 32)), pick("r3", "see ", "of ", "(", "the ", "@", "from ")),
        ("number", pick("s", digits("s1", 16), digits("s2", 13), digits("s3", 18)), pick("s4", " ", "order ", "card ", "tel: ", "id=", "number ", ". ")),
        ("uuid", uuid, pick("t", "id: ", "uuid=\"", "guid ", "request ", "session id ")),
        ("path", F.concat_ws("/", word("u"), word("v"), F.concat(word("w"), digits("x", 2), F.lit(".html"))), pick("y", "see ", "url=", "file: ", "path = \"", " ")),
        ("name", F.concat_ws("_", word("z"), word("za"), digits("zb", 2)), pick("zc", "class ", "def ", "the ", "name = ", " ", "token type ")),
        ("placeholder", pick("zd", "xxxxxxxxxxxx1234", "your_api_key_1234", "example_token_000", "changeme12345678", "0000000000000000", "dummy-secret-1234"), F.concat(key, sep, quote)),
        ("assigned word", pick("zi", syllable("zj"), word("zk"), F.concat(syllable("zl"), syllable("zm")), "null", "none", "true", "false", "string", "required", "optional", "undefined", F.concat_ws("_", word("zn"), syllable("zo")), F.concat_ws(".", syllable("zp"), word("zq"))), F.concat(key, sep, quote)),
        ("version", F.concat(word("ze"), F.lit("-"), digits("zf", 2), F.lit("."), digits("zg", 2), F.lit(".tar.gz")), pick("zh", "download ", "version ", "build ", "package ", " ")),
    ]
    which = r("which", len(harmless))
    base = spark.range(rows).withColumn("label", (r("label", 2) == 0).cast("double"))
    lead = F.concat(word("lead"), pick("stop", " ", ", ", ". ", ' "', "\n"))
    chosen = lambda i: F.array(*(h[i] for h in harmless))[which]
    good = F.col("label") == 1
    before = F.concat(lead, F.when(good, F.concat(key, sep, quote)).otherwise(chosen(2)))
    path = pick("path", "src0", "src/app/main.py", "config/prod.env", "src12", "deploy.yaml", "web/page.html")
    test = F.when(r("test", 10) < F.when(good, 0).otherwise(3), F.lit("tests/fixtures/sample.txt")).otherwise(path)
    return base.select(F.when(good, secret).otherwise(chosen(1)).alias("candidate"), before.alias("before"), pick("after", '" and', "' ,", " the", ".", "\n").alias("after"), test.alias("path"), "label")


def train(findings: DataFrame, trees: int = 40, depth: int = 7, seed: int = 7) -> RandomForestClassificationModel:
    rows, names = features(findings)
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8, cacheNodeIds=False).fit(ready)


def score(model: RandomForestClassificationModel, rows: DataFrame) -> DataFrame:
    """``rows`` (candidate, before, after, path, ...) with ``probability``."""
    ready, names = features(rows)
    out = model.transform(VectorAssembler(inputCols=names, outputCol="features").transform(ready))
    return out.withColumn("probability", F.round(vector_to_array("probability")[1], 6)).select(*rows.columns, "probability")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """doc_id, h, begin, end (code points), candidate, before, after, path."""
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), path.alias("path"), F.col(text_col).alias("text")).where(F.regexp_like("text", F.lit(CANDIDATE)))
    rows = rows.dropDuplicates(["doc_id", "h"])
    marked = F.regexp_replace(F.translate("text", "\x01\x02", "  "), CANDIDATE, "$1\x01$2\x02")
    parts = rows.select("doc_id", "h", "path", F.split(marked, "\x01").alias("parts"))
    parts = parts.select("doc_id", "h", "path", F.posexplode("parts").alias("i", "part"))
    line = Window.partitionBy("doc_id", "h").orderBy("i")
    order = line.rowsBetween(Window.unboundedPreceding, -1)
    own = F.length("part") - F.when(F.col("i") > 0, 1).otherwise(0)  # without the closing mark
    rows = parts.withColumns({"lead": F.right(F.lag("part").over(line), F.lit(64)), "begin": F.coalesce(F.sum(own).over(order), F.lit(0))}).where("i > 0")
    candidate = F.substring_index("part", "\x02", 1)
    return rows.select("doc_id", "h", "begin", (F.col("begin") + F.length(candidate)).alias("end"), candidate.alias("candidate"), F.translate("lead", "\x02", "").alias("before"), F.substring(F.substring_index("part", "\x02", -1), 1, 32).alias("after"), "path")


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD, **columns) -> DataFrame:
    """All candidates with ``probability`` and ``is_secret``. An assignment's key (``password=...``) belongs to the candidate."""
    model = train(labelled_findings(docs.sparkSession) if findings is None else findings)
    found = candidates(docs, **columns)
    cutted = F.regexp_extract("candidate", rf"^([A-Za-z_.\-]*(?i:{KEY_WORDS})=+)", 1)  # a key joined to its value is context
    moved = found.withColumn("key", cutted)
    moved = moved.withColumns({"candidate": F.substring("candidate", F.length("key") + 1, F.length("candidate")), "before": F.concat("before", "key"), "begin": F.col("begin") + F.length("key")}).drop("key")
    return score(model, moved.where(F.length("candidate") > 0)).withColumn("is_secret", F.col("probability") >= threshold)


def redact(docs: DataFrame, found: DataFrame, mask: str = MASK, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced by ``mask``; all columns kept, ``chars_col`` brought up to date."""
    spans = found.where("is_secret").groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("__finding_spans"))
    spans = cut(spans.select(F.col("doc_id").alias("__finding_id"), F.col("h").alias("__finding_h"), "__finding_spans"), "spans")
    joined = docs.join(hinted(spans, BROADCAST_ROWS), F.col(id_col).eqNullSafe(F.col("__finding_id")) & (F.xxhash64(text_col) == F.col("__finding_h")), "left")
    text, s = F.col(text_col), F.col("__finding_spans")
    piece = lambda x, i: F.concat(F.substring(text, F.when(i > 0, F.get(s, i - 1)["end"]).otherwise(0).cast("int") + 1, (x["begin"] - F.when(i > 0, F.get(s, i - 1)["end"]).otherwise(0)).cast("int")), F.lit(mask))
    tail = F.substring(text, F.get(s, F.size(s) - 1)["end"].cast("int") + 1, F.length(text))
    new = F.when(s.isNotNull(), F.concat(F.array_join(F.transform(s, piece), ""), tail)).otherwise(text)
    out = joined.withColumn(text_col, new)
    if chars_col and chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(s.isNotNull(), F.length(text_col).cast("long")).otherwise(F.col(chars_col)))
    return out.select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """Every candidate of every document: doc_id, begin, end, length, probability, is_secret."""
    return scan(docs).select("doc_id", "begin", "end", (F.col("end") - F.col("begin")).alias("length"), "probability", "is_secret")
