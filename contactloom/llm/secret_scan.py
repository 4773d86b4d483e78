"""Secret scans: candidates by pattern, false positives taken out by a random forest.

Everything is a DataFrame expression. One pattern finds candidates: what is assigned to a
name such as ``password`` (a quoted value up to its closing quote, what follows ``Bearer`` or
``Basic``), the forms of well-known providers, private keys from header to end and long
hexadecimal runs. Each candidate gets ``FEATURES``: length, character transitions, dictionary
coverage, the path and the neighbouring words. The forest is trained by Spark on labelled
findings and turned into one expression over those features, so that a text's candidates are
judged inside its row: nothing is exploded, joined or shuffled, however hot a source is.

The path is a column of the table where there is one, else the file that the candidate's own line
names before it.

``labelled_findings`` makes a training table by rule, of a fixed size, from digests and fixed
word lists; ``train`` takes any table of the same columns instead.

Defined cases: a null or empty text has no candidates; repeated rows are judged row by row;
other columns are kept by ``redact`` and left out by ``scan``; an empty table gives no rows;
the control characters 1 and 2, used as marks, stand for themselves in the results of
``redact`` only where a text has no candidate, and are replaced by character 3 elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.5
#: What stands for a secret in a redacted text.
REDACTED = "[SECRET]"
#: Characters before and after a candidate that are looked at.
NEAR = 48

# Names that are given secrets, providers' formats, and word lists.
_NAMES = "passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth"
_PROVIDERS = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    r"gh[pousr]_[A-Za-z0-9]{30,}",
    r"xox[abprs]-[A-Za-z0-9-]{10,}",
    r"AIza[0-9A-Za-z_-]{35}",
    r"sk_(?:live|test)_[0-9A-Za-z]{16,}",
    r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    r"[0-9a-f]{32,}\b",
)
_DASHES = r"[A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
#: A private key from BEGIN to END; without an END, its header lines and what is base64 behind them. Possessive: such loops don't recurse.
_PEM = rf"-----BEGIN {_DASHES}(?:(?:[^-]|-(?!----))*+-----END {_DASHES}|(?:\s*+[A-Za-z-]{{3,20}}: [^\r\n\\]*+(?:\\n|\s)++)*+(?:(?:\\[nr]|[\s\"'+])*+[A-Za-z0-9+/]{{16,}}+={{0,2}}+)*+(?:(?:\\n|\r?\n)[A-Za-z0-9+/]{{1,15}}+={{0,2}}+(?=\s*(?:\\n|[\"'`]|$)|\s*\n))?+)"
_SCHEME = r"(?:(?i:bearer|basic)\s{1,3})?"
_WORDS = "password passwd secret token example sample placeholder changeme change your here test demo dummy fake none null true false value string default user admin name key config config env environ process get set self this var param input load file path data json yaml home lib src bin usr etc opt main index http https www com org net required optional empty undefined insert replace todo xxxx abc the and for with from".split()
_PHRASE = "correct horse battery staple window river dragon monkey summer garden silver purple coffee guitar winter orange lantern rocket velvet marble pencil thunder island copper walnut harbor tunnel magnet pepper saddle bicycle castle feather granite helmet jungle kettle ladder meadow needle".split()
_HARMLESS = "sha1|sha256|sha512|md5|commit|checksum|hash|digest|integrity|etag|revision|uuid|guid|build|blob|example|sample|placeholder|dummy|fake|e\\.g"
#: Words of sentences; a passphrase has few of them.
_PROSE = "a|an|and|are|as|at|be|by|can|do|does|enter|field|for|from|has|have|here|if|in|invalid|is|it|must|no|not|of|on|or|please|required|that|the|this|to|was|we|will|with|you|your"
_QUOTES = "\"'`"
#: Addresses and host names: words inside them say nothing about what stands beside them.
_PLACES = r"[\w.+-]+@[\w.-]+|(?:[\w-]+\.)+(?:com|org|net|edu|gov|[a-z]{2})(?![a-z0-9])|https?://\S+"
_FILE = r"(?i)([\w./-]*[\w-]\.(?:c|cfg|conf|cpp|env|go|ini|java|js|json|lock|md|php|properties|py|rb|rs|sh|toml|ts|txt|xml|ya?ml))(?![\w-])[^\n]*\z"
_TEST_PATHS = "test|spec|example|sample|fixture|mock|demo|docs?/|\\.lock|\\.md"



def _quoted(q: str) -> str:
    """An opening quote, and a value up to its closing one: in its line, or wrapped if its first line is several words."""
    inside = r"|(?<=\w)'(?=\w)" if q == "'" else ""
    in_line = rf"(?:\\.|[^\\{q}\r\n]{inside}){{6,}}+(?={q})"
    wrapped = rf"(?=[^\r\n{q}]*[^\s{q}] +[^\s{q}])(?:[^\\{q}=:\r\n]|\r?\n(?!\s*\n){inside}){{6,}}+(?={q})"
    return rf"((?:{q}{{3}}|{q}){_SCHEME})({_PEM}|{in_line}|{wrapped})"


#: Group 1: an assignment; then an opening quote and a scheme (2, 4, 6; 8: neither needed), each followed by the value; 10: what stands for itself.
PATTERN = rf"((?i:{_NAMES})[\w.-]{{0,20}}[\"']?\s{{0,3}}(?:=>|:=|={{1,3}}|:)\s{{0,3}})(?:{'|'.join(map(_quoted, _QUOTES))}|([\"'`]?{_SCHEME})({_PEM}|[^\s\"'`<>,;]{{6,}}))|(\b(?:{'|'.join(_PROVIDERS)})|{_PEM})"
_A, _B, _C = "\x01", "\x02", "\x03"

FEATURES = ["length", "transitions", "distinct", "digits", "upper", "symbols", "dictionary", "letters_in_a_row", "hexadecimal", "path_like", "test_path", "named", "harmless_near", "provider", "prose"]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.greatest(F.length(value), F.lit(1))


def features(value: Column, before: Column, after: Column, path: Column) -> Column:
    """The doubles of ``FEATURES``, in that order."""
    size = F.greatest(F.length(value), F.lit(1))
    low = F.lower(value)
    near = F.regexp_replace(F.lower(F.concat(before, F.lit(" "), after)), _PLACES, " ")
    flag = lambda x: x.cast("double")
    changes = "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    return F.array(
        F.least(F.length(value), F.lit(200)).cast("double"),
        F.regexp_count(value, F.lit(changes)) / size,
        F.size(F.array_distinct(F.split(value, ""))) / F.least(size, F.lit(64)),
        _share(value, "[0-9]"),
        _share(value, "[A-Z]"),
        _share(value, "[^A-Za-z0-9]"),
        1 - F.length(F.regexp_replace(low, "|".join(sorted(set(_WORDS), key=lambda w: (-len(w), w))), "")) / size,
        F.array_max(F.transform(F.split(low, "[^a-z]+"), F.length)) / size,
        flag(value.rlike("^[0-9a-fA-F]{12,}$")),
        flag(value.rlike(r"[/\\$(){}\[\]]|\.[A-Za-z]{2,5}$|^\w+\.\w+")),
        flag(F.lower(path).rlike(_TEST_PATHS)),
        flag(F.lower(F.right(before, F.lit(32))).rlike(rf"(?:{_NAMES})[\w.-]{{0,20}}[\"']?\s{{0,3}}(?:=>|:=|={{1,3}}|:)\s{{0,3}}[\"'`]{{0,3}}{_SCHEME}$")),
        flag(near.rlike(rf"(?:^|[^a-z])(?:{_HARMLESS})(?:[^a-z]|$)")),
        flag(value.rlike("^(?:" + "|".join((*_PROVIDERS[:-1], f"-----BEGIN {_DASHES}")) + ")")),
        F.regexp_count(low, F.lit(rf"(?<![^\s])(?:{_PROSE})(?![a-z0-9])")) / F.greatest(F.regexp_count(low, F.lit(r"\S+")), F.lit(1)),
    )


def labelled_findings(spark: SparkSession, n: int = 4800) -> DataFrame:
    """(value, before, after, path, label): ``n`` findings, half of them secrets, made from digests and word lists.

    Each kind of value meets each kind of neighbourhood, so that no kind is told by its neighbours alone.
    """
    pick = lambda options, salt: F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(options))) + 1).cast("int"))
    hexes = lambda salt: F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256)
    base = F.regexp_replace(F.base64(F.unhex(hexes("b"))), "[=]", "")
    capital = F.upper(F.regexp_replace(F.base64(F.unhex(hexes("c"))), "[^A-Za-z2-7]", ""))
    length = F.pmod(F.xxhash64("id", F.lit("n")), F.lit(1 << 20)).cast("int")
    word = lambda salt: pick(_WORDS, salt)
    common = lambda salt: pick(["window", "river", "dragon", "monkey", "summer", "garden", "silver", "purple", "coffee", "guitar", "winter", "orange"], salt)
    random_hex, sha = F.substr(hexes("a"), F.lit(1), 12 + F.pmod(length, F.lit(29))), F.substr(hexes("a"), F.lit(1), F.lit(40))
    body = F.regexp_replace(F.concat(*(F.regexp_replace(F.base64(F.unhex(hexes(f"k{j}"))), "[=]", "") for j in range(8))), "(.{64})", "$1\n")
    pem_kind = pick(["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "], "pk")
    pem = lambda inside: F.concat(F.lit("-----BEGIN "), pem_kind, F.lit("PRIVATE KEY-----\n"), inside, F.lit("\n-----END "), pem_kind, F.lit("PRIVATE KEY-----"))
    phrase_word = lambda salt: pick(_PHRASE, salt)
    sentence = pick(["Please enter the {} for this {}", "the {} is not valid", "Your {} must have a {}", "no {} was found in {}", "this is the {} of your {}", "{} is required to {}", "We will send you a {}", "invalid {} or {}"], "v")
    good = [
        random_hex,
        sha,
        F.substr(hexes("a"), F.lit(1), F.lit(18)),
        F.substr(base, F.lit(1), 12 + F.pmod(length, F.lit(31))),
        F.concat(F.initcap(common("w1")), F.substr(hexes("d"), F.lit(1), F.lit(4)), pick(["!", "#", "$7", "_9"], "s")),
        F.concat(F.lit("AKIA"), F.substr(F.rpad(capital, 40, "Q7"), F.lit(1), F.lit(16))),
        F.concat(F.lit("ghp_"), F.substr(F.when(length % 2 == 0, hexes("e")).otherwise(F.regexp_replace(F.concat(base, hexes("e")), "[^A-Za-z0-9]", "")), F.lit(1), F.lit(36))),
        F.concat(F.lit("sk_live_"), F.substr(F.regexp_replace(F.concat(base, hexes("e")), "[^A-Za-z0-9]", ""), F.lit(1), F.lit(24))),
        F.concat(F.concat_ws(" ", phrase_word("p1"), phrase_word("p2"), phrase_word("p3"), F.when(length % 3 > 0, phrase_word("p4")), F.when(length % 5 > 2, phrase_word("p5"))), pick(["", "", "7", " 42", "!"], "pe")),
        pem(F.when(length % 4 > 0, body).otherwise(F.left(body, F.lit(130)))),
    ]
    bad = [
        F.concat(word("w1"), pick(["_", "-", ""], "j1"), word("w2"), pick(["_", "-", ""], "j2"), word("w3")),
        F.concat(F.lit("${"), F.upper(word("w1")), F.lit("_"), F.upper(word("w2")), F.lit("}")),
        F.concat(word("w1"), F.lit("."), word("w2"), F.lit("."), word("w3"), pick(["", "()"], "p")),
        F.concat(F.lit("/"), word("w1"), F.lit("/"), word("w2"), F.lit("/"), common("w3"), pick([".txt", ".json", ".py", ".pem"], "x")),
        F.repeat(pick(["x", "*", "0", "a1", "abc"], "r"), 8 + F.pmod(length, F.lit(10))),
        F.concat(common("w1"), pick(["ing", "ed", "ly", "ation", "er"], "x"), pick(["", ".", ":", ")"], "p")),
        sha,  # what tells it from a secret is what stands around it
        F.concat_ws("-", F.substr(hexes("a"), F.lit(1), F.lit(8)), F.substr(hexes("a"), F.lit(9), F.lit(4)), F.substr(hexes("a"), F.lit(13), F.lit(4)), F.substr(hexes("a"), F.lit(17), F.lit(12))),
        F.regexp_replace(F.regexp_replace(sentence, "\\{\\}$", common("w1")), "\\{\\}", word("w2")),
        F.when(length % 2 == 0, F.concat(F.lit("-----BEGIN "), pem_kind, F.lit("PRIVATE KEY-----"))).otherwise(pem(pick(["...", "<your key here>", "YOUR PRIVATE KEY", "xxxxxxxxxxxxxxxx", "key data"], "d"))),
    ]
    choose = lambda options: F.element_at(F.array(*options), (F.pmod(F.col("id") / 2, F.lit(len(options))) + 1).cast("int"))
    label = (F.col("id") % 2).cast("int")
    kind = F.pmod((F.col("id") / 2).cast("int"), F.lit(len(good)))
    opening = pick(['token = "', "password=", "api_key: '", "SECRET_KEY = '", 'auth_token: "', 'client_secret="', "pwd: ", "Authorization: Bearer ", "Authorization: Basic "], "o")
    quoted = pick(['passphrase = "', "password: '", 'PASSWORD="', "secret = `", 'token: "'], "o")
    stray = pick(["and the ", "see ", "with ", "in line "], "t")
    harmless = pick(["commit ", "sha256: ", "checksum = ", "md5 ", "revision ", "digest: sha512 ", "etag: ", "example token = "], "h")
    rows = spark.range(0, n, 1, 4).select("id", label.alias("label"), kind.alias("kind"), F.when(label == 1, choose(good)).otherwise(choose(bad)).alias("value"), F.when(kind == 8, quoted).otherwise(opening).alias("opening"), stray.alias("stray"), harmless.alias("harmless"), pick(["src/app.py", "config/prod.yaml", "", "", "lib/client.js", ".env"], "f").alias("plain_path"), pick(["tests/test_auth.py", "docs/example.md", "yarn.lock", "spec/fixtures/a.json", "src/app.py", ""], "g").alias("test_path"))
    provider = F.col("kind").isin(5, 6, 7, 9)
    before = F.when((F.col("label") == 1) & provider & (F.xxhash64("id") % 2 == 0), F.col("stray")).when(F.col("label") == 1, F.concat("stray", "opening")).when((F.col("kind") == 6) | (F.col("kind") == 7) | (F.col("kind") == 9) & (F.xxhash64("id") % 2 == 0), F.when(F.xxhash64("id") % 3 == 0, F.col("stray")).otherwise(F.col("harmless"))).otherwise(F.concat("stray", "opening"))
    path = F.when((F.col("label") == 1) | (F.xxhash64("id", F.lit("q")) % 2 == 0), F.col("plain_path")).otherwise(F.col("test_path"))
    return rows.select("value", before.alias("before"), F.lit(" and more").alias("after"), path.alias("path"), "label")


class Forest:
    """A forest as nested conditions: ``votes(features)`` is the share of its trees that say secret."""

    def __init__(self, trees: list[list]):
        self.trees = trees

    def votes(self, row: Column) -> Column:
        def node(tree) -> Column:
            if len(tree) == 1:
                return F.lit(tree[0])
            feature, limit, low, high = tree
            return F.when(row[feature] <= limit, node(low)).otherwise(node(high))

        total = node(self.trees[0])
        for tree in self.trees[1:]:
            total = total + node(tree)
        return total / len(self.trees)


def _parse(lines: list[str]) -> list:
    """One tree of the printed forest, whose lines it uses up."""
    line = lines.pop(0).strip()
    if found := re.fullmatch(r"Predict: ([\d.]+)", line):
        return [float(found[1])]
    found = re.fullmatch(r"If \(feature (\d+) <= ([-\d.E]+)\)", line)
    low = _parse(lines)
    lines.pop(0)  # Else (...)
    return [int(found[1]), float(found[2]), low, _parse(lines)]


def train(findings: DataFrame, *, trees: int = 20, depth: int = 6, seed: int = 7) -> Forest:
    """A forest from labelled findings (value, before, after, path, label), by Spark's own training; null texts count as empty."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = findings.where("label IS NOT NULL").select(F.col("label").cast("double"), array_to_vector(features(*map(text, ("value", "before", "after", "path")))).alias("features"))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=seed, featureSubsetStrategy="onethird").fit(rows)
    lines = [x for x in model.toDebugString.splitlines()[1:] if x.strip()]
    found = []
    while lines:
        lines.pop(0)  # Tree n (weight 1.0):
        found.append(_parse(lines))
    return Forest(found)


def _marked(text: Column) -> Column:
    """The text with a mark before and after each candidate."""
    clean = F.when(F.contains(text, F.lit(_A)) | F.contains(text, F.lit(_B)), F.translate(text, _A + _B, _C * 2)).otherwise(text)
    return F.regexp_replace(clean, PATTERN, f"$1$2$4$6$8{_A}$3$5$7$9$10{_B}")


def _judged(text: Column, path: Column, forest: Forest, then: Callable[[Column, Column], Column]) -> Column:
    """``then(pieces, judged)``, null where no candidate is: the text's pieces, every second a candidate, and of each candidate k, value and score."""

    def judge(pieces: Column) -> Column:
        def one(k: Column) -> Column:
            before = F.right(pieces[k - 1], F.lit(NEAR))
            # where the table names no path, the file that the line names before the candidate
            place = F.when(path != "", path).otherwise(F.regexp_extract(before, _FILE, 1))
            row = features(pieces[k], before, F.left(pieces[k + 1], F.lit(NEAR)), place)
            return _let(row, lambda x: F.struct(k.alias("k"), forest.votes(x).alias("score")))

        return _let(F.transform(F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), one), lambda found: then(pieces, found))

    return _let(_marked(text), lambda m: F.when(F.contains(m, F.lit(_A)), _let(F.split(m, f"[{_A}{_B}]", -1), judge)))


#: Pieces whose lengths are summed at a time.
_RUN = 256


def _located(pieces: Column, found: Column) -> Column:
    """Where each candidate starts: whole runs of pieces before it, then the rest of its run."""
    add = lambda a, x: a + x
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), add)

    def with_runs(lengths: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _RUN).cast("int")), lambda r: total(F.slice(lengths, r * _RUN + 1, F.lit(_RUN))))

        def place(x: Column, sums: Column) -> Column:
            k = x["k"]
            start = total(F.slice(sums, F.lit(1), F.floor(k / _RUN).cast("int"))) + total(F.slice(lengths, F.floor(k / _RUN).cast("int") * _RUN + 1, k % _RUN))
            return F.struct(start.alias("start"), F.length(pieces[k]).cast("long").alias("length"), F.sha2(pieces[k], 256).alias("value_sha256"), x["score"].alias("score"))

        return _let(runs, lambda sums: F.transform(found, lambda x: place(x, sums)))

    return _let(F.transform(pieces, lambda x: F.length(x).cast("long")), with_runs)


def scan(docs: DataFrame, forest: Forest, *, threshold: float = THRESHOLD, doc_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(doc_id, start, length, value_sha256, score, secret) of each candidate; ``start`` counts characters from 0. No row is shuffled."""
    path = F.coalesce(F.col(path_col), F.lit("")) if path_col else F.lit("")
    found = docs.select(F.col(doc_col).alias("doc_id"), F.explode_outer(_judged(F.col(text_col), path, forest, _located)).alias("found"))
    return found.where("found IS NOT NULL").select("doc_id", "found.*", (F.col("found.score") >= threshold).alias("secret"))


def redact(docs: DataFrame, forest: Forest, *, threshold: float = THRESHOLD, text_col: str = "text", path_col: str | None = None, length_col: str | None = None) -> DataFrame:
    """The documents with all their columns, each secret replaced by ``REDACTED``; ``length_col`` gets the new number of characters."""
    path = F.coalesce(F.col(path_col), F.lit("")) if path_col else F.lit("")

    def rebuilt(pieces: Column, found: Column) -> Column:
        bad = F.transform(F.filter(found, lambda x: x["score"] >= threshold), lambda x: x["k"])
        # in order: outside, candidate, outside, candidate, ..., outside
        return _let(bad, lambda ks: F.when(F.size(ks) > 0, F.array_join(F.transform(pieces, lambda x, k: F.when((k % 2 == 1) & (found[F.floor(k / 2).cast("int")]["score"] >= threshold), F.lit(REDACTED)).otherwise(x)), "")))

    new = F.coalesce(_judged(F.col(text_col), path, forest, rebuilt), F.col(text_col))
    done = docs.withColumn(text_col, new)
    return done.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col else done


QUERY = "op10_secret_scan"


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), train(labelled_findings(spark)))
