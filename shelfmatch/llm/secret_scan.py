"""Secret scans with a random forest against false positives.

Candidates are values given to a secret-like name (alone or within a longer one), of any length and any characters
but blanks, passwords within an address (``scheme://user:password@host``), and elsewhere runs of 16 or more key-like characters that hold a digit or mixed case. Features: length; shares of character kinds; transitions between kinds and between vowels
and consonants; entropy; coverage by dictionary words; words of the path; words before and after. The dictionary is a short
list and the ``CORPUS_WORDS`` words that occur in most of the scanned documents (``corpus_words``). The forest
is trained from labelled findings ``(candidate, before, after, path, label)``, at most ``MAX_FINDINGS`` of
them (those of least hash); where a caller has none, ``labelled_findings`` makes a set from rules.

Defined results: null and empty texts have no candidates; a null path has no words; a candidate of any length
is one finding; repeated rows and repeated candidates are each reported; an empty table gives no rows; a
single label makes every candidate that label, and no labelled findings at all make every probability 0, so that nothing is reported; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmatch.llm._common import map_arrow, table

RUN = re.compile(r"[A-Za-z0-9+/_\-.~]{16,}={0,2}")
ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]{1,30}://[^\s:/@]{0,200}:([^\s@/\"']+)@")
ASSIGNED = re.compile(r"(?i:password|passwd|passphrase|pwd|secret|token|api[_-]?key|private[_-]?key|access[_ -]?key)[\w\-]{0,40}[\"']?\]?\s{0,20}(?::=|=>|==?|:)\s{0,20}(?:\"([^\s\"]+)|'([^\s']+)|([^\s\"']+))")
_TAIL = ",;.)]}>"  # behind a bare value
NEAR = 40
TREES, DEPTH, LEAST_LEAF = 32, 12, 2
MAX_FINDINGS = 20_000
CORPUS_WORDS = 20_000
SHORTEST_WORD, LONGEST_WORD = 4, 20
KEEP_FROM = 0.5
DICTIONARY = "about account after again all also and any are base because been before between both build but can change class code come config could data date day default demo did document does down each error even example file find first for from function get give good great group hand has have help here high home how image index into item just key know large last level like line list local long look made main make many may media method more most much must name need never new next not now number object of off only open order other our out over own page part path people place point post public put read report request result right same sample say see service set should show side small some source start state string such system table take test than that the their them then there these they this time type under update use user value version very want was way well were what when where which while who will with word work world would write year you your".split()
SECRET_WORDS = frozenset("token secret password passwd pwd key apikey api auth authorization bearer credential credentials private access signature login".split())
BENIGN_WORDS = frozenset("sha sha1 sha256 md5 checksum digest hash commit revision etag uuid guid id version build image layer tree blob integrity fingerprint object".split())
MADE_UP = frozenset("example sample dummy changeme placeholder your test fake todo xxxx none redacted insert here".split())
TEST_PATHS = frozenset("test tests example examples docs doc sample samples fixture fixtures mock demo".split())
CONFIG_PATHS = frozenset("config conf env settings secrets credentials deploy prod production ini yaml yml properties".split())
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-", "AIza", "eyJ", "npm_")
_WORDS = re.compile(r"[a-z]+\d*")
_VOWELS = frozenset("aeiouy")
BASE_WORDS = frozenset(w for w in {*DICTIONARY, *SECRET_WORDS, *MADE_UP} if len(w) >= SHORTEST_WORD)
FEATURES = "length log_length digits upper lower other kind_changes vowel_changes entropy distinct longest_run hexadecimal dictionary made_up prefix secret_near benign_near assigned quoted test_path config_path words_near".split()


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def corpus_words(docs: DataFrame, text: str = "text", most: int = CORPUS_WORDS) -> list[str]:
    """The ``most`` words of 4 to 20 letters that occur in most documents, counted over all of them; ties by word."""
    letters = F.regexp_extract_all(F.lower(F.col(text).cast("string")), F.lit(rf"\p{{L}}{{{SHORTEST_WORD},{LONGEST_WORD}}}"), F.lit(0))
    each = docs.select(F.explode(F.array_distinct(letters)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return [r["word"] for r in each.orderBy(F.desc("n"), "word").limit(most).collect()]


def coverage(low: str, words: frozenset[str]) -> float:
    """The greatest share of the characters that words, none over another, can cover."""
    best = [0]
    for i in range(1, len(low) + 1):
        here = best[-1]
        for n in range(SHORTEST_WORD, min(LONGEST_WORD, i) + 1):
            if best[i - n] + n > here and low[i - n : i] in words:
                here = best[i - n] + n
        best.append(here)
    return best[-1] / max(1, len(low))


def features(candidate: str, before: str, after: str, path: str | None, words: frozenset[str] = BASE_WORDS) -> list[float]:
    n = len(candidate)
    counts = Counter(candidate)
    kinds = [_kind(c) for c in candidate]
    shares = [kinds.count(k) / n for k in range(4)]
    low = candidate.lower()
    letters = [c in _VOWELS for c in low if c.isalpha()]
    run = best = 1
    for a, b in zip(candidate, candidate[1:], strict=False):
        run = run + 1 if a == b else 1
        best = max(best, run)
    near = _WORDS.findall((before + " " + after).lower())
    just = before.rstrip()
    parts = frozenset(_WORDS.findall((path or "").lower()))
    return [
        n,
        math.log(n),
        *shares,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1),
        sum(a != b for a, b in zip(letters, letters[1:], strict=False)) / max(1, len(letters) - 1),
        -sum(v / n * math.log2(v / n) for v in counts.values()),
        len(counts) / n,
        best,
        float(all(c in "0123456789abcdef" for c in low)),
        coverage(low, words),
        float(any(w in low for w in MADE_UP)),
        float(candidate.startswith(PREFIXES)),
        float(any(w in SECRET_WORDS for w in near)),
        float(any(w in BENIGN_WORDS for w in near)),
        float(just.rstrip("\"'")[-1:] in ("=", ":") or just[-1:] in ("=", ":")),
        float(before[-1:] in ('"', "'") and after[:1] in ('"', "'")),
        float(bool(parts & TEST_PATHS)),
        float(bool(parts & CONFIG_PATHS)),
        len(near),
    ]


def _runs(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    for m in RUN.finditer(text, start, end):
        found = m[0]
        core = found.strip("=.-_~/+")
        a = m.start() + len(found) - len(found.lstrip("=.-_~/+"))
        if len(core) >= 16 and (any(c.isdigit() for c in core) or (any(c.isupper() for c in core[1:]) and any(c.islower() for c in core))):
            yield a, a + len(core)


def candidates(text: str) -> Iterator[tuple[int, str, str, str]]:
    """(start, candidate, before, after)."""
    spans, done = [], 0
    for m in sorted([*ASSIGNED.finditer(text), *ADDRESS.finditer(text)], key=lambda m: m.start()):
        if m.start() < done:
            continue
        a, b = m.span(m.lastindex)
        if m.re is ASSIGNED and m[3]:
            b = a + (len(m[3].rstrip(_TAIL)) or len(m[3]))
        spans += _runs(text, done, m.start())
        spans.append((a, b))
        done = m.end()
    spans += _runs(text, done, len(text))
    for a, b in spans:
        yield a, text[a:b], text[max(0, a - NEAR) : a], text[b : b + NEAR]


class Forest:
    """Trees on bootstrap samples; each split is the best of a few random features by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.words = BASE_WORDS
        self.trees = [self._tree(x, y, rng.integers(0, len(y), len(y)), depth, rng) for _ in range(trees)] if len(y) else []

    def _tree(self, x, y, rows, depth, rng):
        nodes: list[list[float]] = []  # feature, threshold, left, right, share

        def grow(rows, depth) -> int:
            at = len(nodes)
            share = float(y[rows].mean())
            nodes.append([-1, 0.0, -1, -1, share])
            if depth == 0 or share in (0.0, 1.0) or len(rows) < 2 * LEAST_LEAF:
                return at
            best = None
            for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5)), replace=False):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, pos = x[order, f], np.cumsum(y[order])
                k = np.flatnonzero(v[1:] > v[:-1]) + 1
                k = k[(k >= LEAST_LEAF) & (k <= len(rows) - LEAST_LEAF)]
                if not len(k):
                    continue
                left, right = pos[k - 1] / k, (pos[-1] - pos[k - 1]) / (len(rows) - k)
                impurity = k * left * (1 - left) + (len(rows) - k) * right * (1 - right)
                j = int(impurity.argmin())
                if best is None or impurity[j] < best[0]:
                    best = (impurity[j], f, (v[k[j] - 1] + v[k[j]]) / 2)
            if best is not None:
                _, f, t = best
                less = x[rows, f] <= t
                nodes[at][:4] = [f, t, grow(rows[less], depth - 1), grow(rows[~less], depth - 1)]
            return at

        grow(rows, depth)
        return np.array(nodes)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for nodes in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = nodes[at, 0].astype(np.int64)
                inner = f >= 0
                if not inner.any():
                    break
                less = x[np.arange(len(x)), np.maximum(f, 0)] <= nodes[at, 1]
                at = np.where(inner, np.where(less, nodes[at, 2], nodes[at, 3]), at).astype(np.int64)
            out += nodes[at, 4]
        return out / max(1, len(self.trees))


def labelled_findings(n: int = 6000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings made from rules: (candidate, before, after, path, label). The lines around them are of env and
    settings files, code, logs and prose, with English words."""
    r = random.Random(seed)
    pick = r.choice
    drawn = lambda k, of: "".join(pick(of) for _ in range(k))
    hexa = lambda k: drawn(k, "0123456789abcdef")
    mixed = lambda k, more="": drawn(k, string.ascii_letters + string.digits + more)
    prose = lambda k: " ".join(r.sample(DICTIONARY, k))
    phrase = lambda: "".join(r.sample(DICTIONARY, r.randint(2, 4)))
    names = "token api_key secret password auth_token access_key private_key apikey db_password client_secret AWS_SECRET_ACCESS_KEY GITHUB_TOKEN SECRET_KEY smtp-password accessKey apiSecret".split() + ["access key", "api key"]
    folders = "app lib services/billing deploy config web/server notebooks scripts infra/terraform docs tests examples".split()
    files = "main.py settings.yml .env prod.env index.js README.md values.yaml login_test.go secrets.json run.sh notes.txt".split()
    key = lambda: pick([lambda: hexa(r.randint(24, 64)), lambda: hexa(pick([32, 40, 48, 64])), lambda: mixed(r.randint(18, 64)), lambda: mixed(r.randint(24, 60), "+/") + pick(["", "=", "=="]), lambda: pick(PREFIXES) + mixed(r.randint(16, 40)), lambda: mixed(r.randint(20, 48), "_-")])()
    chosen = lambda: pick([lambda: mixed(r.randint(6, 15), "_-"), lambda: mixed(r.randint(6, 20), "!#$%&*?^") + pick("!#$%&*?^") + drawn(r.randint(0, 3), string.digits), lambda: phrase() + pick(["", str(r.randint(0, 9999)), "!" + str(r.randint(0, 99)), "#1"]), lambda: pick(DICTIONARY).capitalize() + pick(["@", "!", "_", ""]) + str(r.randint(10, 99999)) + pick(["", "!", "x"])])()
    refs = ["${%s}", "os.environ[%s]", "getenv(%s)", "<%s>", "{{%s}}", "config.%s", "args.%s", "$%s", "****%s", "process.env.%s"]
    host = lambda: f"{pick(DICTIONARY)}{r.randint(0, 9)}.{pick(['internal', 'example.com', 'local'])}"
    out = []
    for _ in range(n):
        path = pick([f"{pick(folders)}/{pick(files)}", pick(files), f"shard-{r.randint(0, 9999)}", ""])
        around, behind = prose(r.randint(0, 4)), prose(r.randint(0, 4))
        given = pick([" = ", "=", ": ", " : ", " := ", "="])
        quote = pick(['"', '"', "'", ""])
        label = int(r.random() < 0.5)
        if label:
            kind = r.randrange(10)
            value = key() if kind < 7 else chosen()
            before, after = f"{around} {pick(names)}{given}{quote}", f"{quote} {behind}"
            if kind == 9:
                value = value.replace("/", "").replace("@", "")
                before, after = f"{around} {pick(['postgres', 'mongodb', 'redis', 'https', 'amqp', 'mysql+pymysql'])}://{pick(['admin', 'root', 'app', ''])}:", f"@{host()}:{r.randint(80, 9000)}/{behind}"
            elif value.startswith(PREFIXES) and r.random() < 0.5:
                before, after = around + " ", " " + behind
        else:
            kind = r.randrange(12)
            before, after = around + " ", pick([" ", "", ".", ","]) + behind
            if kind == 0:
                value, before = hexa(pick([32, 40, 56, 64, 96])), f"{around} {pick(['sha1', 'sha256', 'md5', 'commit', 'checksum', 'etag', 'digest', 'revision', 'image layer', 'integrity'])}{pick([': ', ' ', '=', ':', ' = '])}{quote}"
            elif kind == 1:
                value = "-".join(hexa(k) for k in (8, 4, 4, 4, 12))
                before = f"{around} {pick(['uuid', 'id', 'guid', 'object', 'request'])}{pick([': ', '=', ' ', ' = '])}{quote}"
            elif kind == 2:
                value = pick(["your_api_key_here", "EXAMPLE_TOKEN", "xxxxxxxxxxxxxxxx", "changeme", "insert-your-token-here", "sample0000000000", "REDACTED", "dummy_password", "placeholder"]) + pick(["", "0", "_1", "abc"])
                before, after = f"{around} {pick(names)}{given}{quote}", quote + " " + behind
            elif kind == 3:
                value = "".join(w.capitalize() for w in r.sample(DICTIONARY, r.randint(3, 6))) + pick(["", "2", "Impl"])
            elif kind == 4:
                value = pick(["/", "_", "-", "."]).join([*r.sample(DICTIONARY, r.randint(3, 5)), str(r.randint(0, 2030))])
            elif kind == 5:
                value = drawn(r.randint(16, 24), string.digits)
            elif kind == 6:
                value = hexa(pick([32, 40])) if r.random() < 0.5 else f"{pick(DICTIONARY)}-{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 99)}-{pick(['linux', 'darwin'])}-x86_64"
                before = f"{around} {pick(['version', 'build', 'release', 'at', 'merge', 'blob', 'tree'])} "
            elif kind == 7:
                value = f"{pick(DICTIONARY)}{pick(['.', '_'])}{pick(DICTIONARY)}{r.randint(0, 99)}.{host()}"
            elif kind == 8:
                value, before = pick([pick(DICTIONARY), str(r.randint(0, 4096)), "None", "null", "true", "false", "str", "string"]), f"{around} {pick(['token', 'secret', 'password', 'tokens', 'token_count', 'max_tokens'])}{pick([': ', ' = ', ': '])}"
                after = " " + behind
            elif kind == 9:
                value, before = pick(refs) % pick(["TOKEN", "password", "DB_PASSWORD", "secret", "api_key", ""]), f"{around} {pick(names)}{given}"
                after = " " + behind
            elif kind == 10:
                value = f"2{r.randint(0, 9)}{r.randint(10, 99)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}-{r.randint(10, 59)}-{r.randint(10, 59)}Z"
            else:
                value, before, after = pick(refs) % "PASSWORD", f"{around} {pick(['postgres', 'mongodb', 'https'])}://app:", f"@{host()}/{behind}"
        out.append((value, before[-NEAR:], after[:NEAR], path, label))
    return out


def train(findings: DataFrame, words: list[str] | None = None, most: int = MAX_FINDINGS) -> Forest:
    """A forest from labelled rows ``candidate, before, after, path, label``; rows without a candidate or label are passed
    over. ``words`` are added to the dictionary, also of what the forest is used on."""
    dictionary = BASE_WORDS | frozenset(words or [])
    kept = findings.filter("candidate <> '' and label is not null").orderBy(F.xxhash64("candidate", "before", "after", "path", "label"), "candidate", "before", "label").limit(most)
    rows = kept.select("candidate", F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), "path", "label").collect()
    x = np.array([features(*r[:4], dictionary) for r in rows], np.float64).reshape(len(rows), len(FEATURES))
    out = Forest(x, np.array([r[4] for r in rows], np.float64))
    out.words = dictionary
    return out


def scan(docs: DataFrame, forest: Forest, key: str = "doc_id", text: str = "text", path: str = "source", keep_from: float = KEEP_FROM) -> DataFrame:
    """``key, start, finding, probability`` of the candidates that the forest takes for secrets."""
    model = docs.sparkSession.sparkContext.broadcast(forest)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, starts, found, rows = [], [], [], []
            paths = batch.column(2).to_pylist()
            for k, t in enumerate(batch.column(1).to_pylist()):
                for start, candidate, before, after in candidates(t or ""):
                    take.append(k)
                    starts.append(start)
                    found.append(candidate)
                    rows.append(features(candidate, before, after, paths[k], model.value.words))
            if not take:
                continue
            p = model.value.predict(np.array(rows, np.float64))
            out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take)), pa.array(starts, pa.int64()), pa.array(found, pa.string()), pa.array(p)], [key, "start", "finding", "probability"])
            yield out.filter(pa.array(p >= keep_from))

    return map_arrow(docs.select(key, F.col(text).cast("string").alias("_text"), F.col(path).cast("string").alias("_path")), run, f"{key} {kind}, start long, finding string, probability double")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = spark.createDataFrame(labelled_findings(), "candidate string, before string, after string, path string, label int")
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(findings, corpus_words(docs)))
