"""Secret scans: pattern candidates, and a random forest that removes false positives.

Patterns name candidates in whole texts; each gets features of its characters and of the
words around it, and a random forest trained from labelled findings tells secrets from
identifiers, paths, versions, checksums and plain words.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, without

# Words that name a secret, words that name something else, and common words of text, paths and code.
SECRET_WORDS = "token secret password passwd pwd passphrase apikey api_key api-key access_key accesskey secret_key private_key auth authorization bearer credential credentials client_secret".split()
OTHER_WORDS = "commit sha sha1 sha256 md5 checksum digest hash revision version uuid guid etag id ref branch build example sample test placeholder dummy serial isbn doi url href src path file image".split()
PLACEHOLDERS = "example sample placeholder changeme dummy test your xxxx todo none null default insert redacted".split()
ITSELF = "secret password token".split()
COMMON = (
    "the and for that with this from are was not have which will can all one has been there more when who would what about into time them some could other than then now only over also "
    "user users home usr var lib bin etc opt tmp src main test tests docs data file files image images static assets index page config build dist node modules package packages python java "
    "http https www com org net html json xml css txt png jpg svg pdf zip tar get set new old add remove update create delete list item items name value type class function method return string "
    "number error info debug warn level server client request response session cache model view controller service manager handler factory utils common core base"
).split()

_NAME = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|credential)(?:[_-]?(?:key|token|value|hash))?s?"
_SET = r"[\"']?\s{0,4}(?::=|=>|[:=])\s{0,4}(?:(?:bearer|basic|token)\s{1,4})?"
#: A value under a name of a secret: in quotes to the closing one, else to white space, quote, comma, semicolon or the next parameter of an address.
_KEYED = re.compile(rf"(?i)(?<![A-Za-z0-9])[A-Za-z0-9_-]{{0,40}}{_NAME}{_SET}(?:\"([^\"\n]{{6,}})\"|'([^'\n]{{6,}})'|`([^`\n]{{6,}})`|[\"'`]?((?:(?!&[A-Za-z_][A-Za-z0-9_.-]*=)[^\s\"'`,;]){{6,}}))")
_BEARER = re.compile(r"(?i)(?<![A-Za-z0-9])bearer\s{1,4}([A-Za-z0-9._~+/=-]{12,})")
_URL = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s:/@\"']{0,64}:([^\s/@\"']{3,})@")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=.~-])(?=[A-Za-z0-9+/_=.~-]{12})[A-Za-z+/_=.~-]*+\d[A-Za-z0-9+/_=.~-]*+")
_MARKED = re.compile(r"(?<![A-Za-z0-9+/_.~-])(?:AKIA|ASIA|gh[pousr]_|github_pat_|xox[abprs]-|sk_live_|rk_live_|AIza|eyJ|glpat-|npm_|SG\.)[A-Za-z0-9+/_=.~-]{10,}")
#: A private key to its end line; without one, its headers and long lines of key text.
_BLOCK = re.compile(
    r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
    r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|(?:\s+(?:Proc-Type:[^\n]*|DEK-Info:[^\n]*|[A-Za-z0-9+/=]{16,}))*)"
)
_PREFIXED = re.compile(r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|xox[abprs]-|sk_live_|rk_live_|AIza|eyJ|glpat-|npm_|SG\.)")
_WORDS = re.compile(r"[A-Za-z_][A-Za-z_-]*")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
_VERSION = re.compile(r"^[vV]?\d+(?:\.\d+)+(?:[-+.][A-Za-z0-9.-]*)?$")
_PLAIN = re.compile(r"[A-Za-z]?[a-z]+(?:[ ._-][A-Za-z]?[a-z]+)*|[A-Z]+(?:[ ._-][A-Z]+)*")
_EXTENSION = re.compile(r"\.[A-Za-z]{2,5}\d?$")

#: Code points before and after a candidate in which neighbouring words are looked for.
NEIGHBOURHOOD = 40
FEATURES = (
    "length digits upper lower symbols entropy changes transitions dictionary longest_word hex_only hex_size base64 uuid version "
    "slashes dots extension path placeholder repeats runs prefixed keyed near_secret near_other quoted assigned reference words_only"
).split()


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of candidates in order, none within another.

    Where they overlap, key blocks come before passwords of addresses, these before values under
    names of secrets, these before known prefixes, these before other tokens, and of one kind the first.  Every candidate is whole,
    however long.
    """
    found = [(0, m.start(), m.end(), "private_key") for m in _BLOCK.finditer(text)]
    found += [(1, m.start(1), m.end(1), "url") for m in _URL.finditer(text)]
    for m in _KEYED.finditer(text):
        a, b = m.span(m.lastindex)
        if m.lastindex == 4:  # bare: what closes the sentence or bracket around it is not its own
            value = text[a:b]
            b = a + max(6, len(value.rstrip("." if any(c in value for c in "([{<") else ")]}>.")))
        found.append((2, a, b, "keyed"))
    found += [(2, m.start(1), m.start(1) + len(m[1].rstrip(".")), "keyed") for m in _BEARER.finditer(text)]
    found += [(3, m.start(), m.start() + len(m[0].rstrip(".-~/")), "token") for m in _MARKED.finditer(text)]
    for m in _TOKEN.finditer(text):
        end = m.start() + len(m[0].rstrip(".=-~/")) if not m[0].endswith("=") else m.end()
        if end - m.start() >= 12 and any(c.isalpha() for c in m[0]):
            found.append((4, m.start(), end, "token"))
    starts: list[int] = []
    out: list[tuple[int, int, str]] = []
    for _, a, b, kind in sorted(found):
        k = bisect_left(starts, a)
        if (k == 0 or out[k - 1][1] <= a) and (k == len(out) or out[k][0] >= b):
            starts.insert(k, a)
            out.insert(k, (a, b, kind))
    return out


class Transitions:
    """Log-probabilities of one character after another in ordinary text, learned from words."""

    def __init__(self, words: list[str]):
        self.pairs: Counter = Counter()
        for w in words:
            self.pairs.update(zip(w, w[1:], strict=False))
        self.first: Counter = Counter()
        for (a, _), n in self.pairs.items():
            self.first[a] += n

    def __call__(self, value: str) -> float:
        v = value.lower()
        logs = [math.log((self.pairs[a, b] + 0.1) / (self.first[a] + 4.0)) for a, b in zip(v, v[1:], strict=False)]
        return sum(logs) / max(1, len(logs))


_ordinary = Transitions(COMMON + OTHER_WORDS)


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    value = text[start:end]
    n = len(value)
    before, after = text[max(0, start - NEIGHBOURHOOD) : start], text[end : end + NEIGHBOURHOOD]
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
    count, low = Counter(value), value.lower()
    share = Counter(kinds)
    covered, longest = bytearray(n), 0
    for w in COMMON + OTHER_WORDS:
        at = low.find(w) if len(w) > 3 else -1
        while at >= 0:
            covered[at : at + len(w)] = b"\1" * len(w)
            longest, at = max(longest, len(w)), low.find(w, at + 1)
    words = [w.lower() for w in _WORDS.findall(before)[-4:] + _WORDS.findall(after)[:2]]
    hexed = all(c in string.hexdigits for c in value)
    return [
        math.log(n), share["d"] / n, share["u"] / n, share["l"] / n, share["s"] / n,
        -sum(k / n * math.log2(k / n) for k in count.values()), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        _ordinary(value), sum(covered) / n, longest, hexed, n if hexed else 0, bool(re.fullmatch(r"[A-Za-z0-9+/_-]{16,}={0,2}", value)), bool(_UUID.match(value)),
        bool(_VERSION.match(value)), value.count("/"), value.count("."), bool(_EXTENSION.search(value)), before[-1:] in ("/", "\\", "@") or value[:1] in "/.~",
        2 * any(p in low for p in PLACEHOLDERS) or any(p in low for p in ITSELF), max(count.values()) / n, sum(ord(b) - ord(a) == 1 for a, b in zip(value, value[1:], strict=False)) / n,
        bool(_PREFIXED.match(value)), kind != "token", any(s in w for w in words for s in SECRET_WORDS), any(w in OTHER_WORDS for w in words),
        before[-1:] in ("\"", "'", "`"), bool(re.search(r"[:=>]\s*[\"'`]?$", before)), value[:1] in "$<{%(" or "(" in value or "[" in value, bool(_PLAIN.fullmatch(value)),
    ]


class Forest:
    """A random forest of Gini trees: bootstrapped rows, a random part of the features at each split."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 12, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.trees = [self._grow(x[at], y[at], depth, rng) for at in (rng.integers(0, len(y), len(y)) for _ in range(trees))] if len(y) else []

    @staticmethod
    def _grow(x: np.ndarray, y: np.ndarray, depth: int, rng) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, share = [], [], [], [], []
        todo = [(np.arange(len(y)), depth, None)]
        while todo:
            rows, d, link = todo.pop()
            me, own = len(feature), y[rows]
            if link:
                (left if link[1] else right)[link[0]] = me
            p = own.mean()
            feature.append(-1), cut.append(0.0), left.append(-1), right.append(-1), share.append(p)
            if d == 0 or p in (0.0, 1.0) or len(rows) < 4:
                continue
            best = (0.0, -1, 0.0)
            for f in rng.choice(x.shape[1], int(np.ceil(np.sqrt(x.shape[1]))), replace=False):
                order = np.argsort(x[rows, f], kind="stable")
                v, t = x[rows, f][order], np.cumsum(own[order])
                n = np.arange(1, len(v))
                a, b = t[:-1] / n, (t[-1] - t[:-1]) / (len(v) - n)
                gain = p * (1 - p) - (n * a * (1 - a) + (len(v) - n) * b * (1 - b)) / len(v)
                gain[v[1:] == v[:-1]] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-12:
                    best = (gain[k], int(f), (v[k] + v[k + 1]) / 2)
            if best[1] >= 0:
                feature[me], cut[me] = best[1], best[2]
                low = x[rows, best[1]] <= best[2]
                todo += [(rows[low], d - 1, (me, True)), (rows[~low], d - 1, (me, False))]
        return tuple(np.array(a) for a in (feature, cut, left, right, share))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The trees' mean share of secrets."""
        out = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                rows = np.flatnonzero(inner)
                f = feature[at[rows]]
                at[rows] = np.where(x[rows, f] <= cut[at[rows]], left[at[rows]], right[at[rows]])
            out += share[at]
        return out / max(1, len(self.trees))


def labelled_findings(n: int = 6000, seed: int = 7) -> list[tuple[str, int, int, int]]:
    """Made-up findings to learn from: text, start, end, and 1 for a secret. Half are secrets.

    Secrets are random keys and human passwords under names of secrets, in addresses and
    headers, or with known prefixes, and key blocks; the others are checksums, versions, paths,
    identifiers, placeholders, references to variables and words, in their usual company.
    """
    rng = random.Random(seed)
    letters, hexes, b64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    word = lambda: rng.choice(COMMON)
    syllables = lambda k: "".join(pick("bcdfghklmnprstvw", 1) + pick("aeiou", 1) for _ in range(k))
    some = lambda k: " ".join(word() if rng.random() < 0.6 else syllables(rng.randint(1, 4)) for _ in range(k))
    human = lambda: rng.choice([word, lambda: syllables(rng.randint(2, 4))])() + rng.choice(["", "_", "-", "!", "."]) + str(rng.randint(1, 9999)) + rng.choice(["", "!", "#", "$", word(), word().title(), rng.choice(["secret", "pass", "token"])])
    keys = [
        lambda: pick(hexes, rng.choice([32, 40, 48, 64])), lambda: pick(letters, rng.randint(16, 48)), lambda: pick(b64, rng.choice([40, 44, 64])) + rng.choice(["", "="]), lambda: pick(hexes, 40).upper(),
        lambda: pick(letters + "!@#%^&*", rng.randint(10, 20)), lambda: pick(string.ascii_letters, rng.randint(20, 40)), lambda: human().title(), human, human,
        lambda: rng.choice("-_.").join([word(), syllables(2), pick(letters + "@#!$", rng.randint(10, 24))]), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(letters, 36), lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(letters, 24),
        lambda: "eyJ" + pick(letters, 30) + ".eyJ" + pick(letters, 40) + "." + pick(letters + "_-", 43),
    ]
    hashes = "commit sha sha256 md5 checksum digest revision etag build".split()
    others = [
        lambda: (pick(hexes, rng.choice([32, 40, 64])), rng.choice(hashes)),
        lambda: (pick(hexes, rng.choice([7, 12, 40])), ""),
        lambda: ("-".join(pick(hexes, m) for m in (8, 4, 4, 4, 12)), rng.choice(["id", "uuid", "guid", "ref", ""])),
        lambda: (rng.choice(["v", ""]) + ".".join(str(rng.randint(0, 30)) for _ in range(3)) + rng.choice(["", "-beta.1", "+build5", "-rc12.final"]), rng.choice(["version", ""])),
        lambda: ("/".join(word() for _ in range(rng.randint(2, 6))) + f"{rng.randint(0, 99)}." + rng.choice(["py", "js", "png", "html", "txt"]), rng.choice(["path", "file", "src", ""])),
        lambda: (f"{word()}{rng.randint(1, 20)}.{word()}.{rng.choice(['com', 'org', 'net'])}", rng.choice(["url", "href", ""])),
        lambda: (f"{word()}-{word()}-{rng.randint(1, 9999)}-{word()}", rng.choice(["id", "branch", ""])),
        lambda: (word().title() + word().title() + str(rng.randint(1, 99)) + word().title(), ""),
        lambda: (rng.choice(["your-token-here1", "xxxxxxxxxxxx1234", "EXAMPLEKEY123456", "changeme123456", "<insert-secret-1>", "dummy-password-1", "REDACTED00000000", "1234567890abcdef", "aaaaaaaaaaaaaaa1", "abcdefghijkl1234", "YOUR_API_KEY", "your_password", "********", "<password>", "null or none"]), rng.choice(SECRET_WORDS)),
        lambda: (rng.choice(["", "my-", "your_"]) + rng.choice(PLACEHOLDERS) + rng.choice(["", "-", "_"]) + str(rng.randint(0, 9999)) + rng.choice(["", word()]), rng.choice(SECRET_WORDS)),
        lambda: (rng.choice(["${%s_%s}", "$%s_%s", "{{ %s.%s }}", "<%s-%s>", "%%%s_%s%%", "$(%s_%s)"]) % (word().upper(), rng.choice(SECRET_WORDS).upper()), rng.choice(SECRET_WORDS)),
        lambda: (f"20{rng.randint(10, 29)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}", rng.choice(["", "build"])),
        lambda: (rng.choice(["{}_{}({})", "os.environ['{}_{}_{}']", "${{{}_{}_{}}}", "{}.{}_{}()", "%({}_{}_{})s", "process.env.{}.{}.{}"]).format(word(), word(), word()), rng.choice(SECRET_WORDS)),
        lambda: (rng.choice([word() + rng.choice(["s", "ed", "ing", "able", "ment"]), syllables(rng.randint(3, 5)), f"{word()} {word()} {word()}", f"{word()}.{word()}"]), rng.choice(SECRET_WORDS)),
        lambda: (syllables(rng.randint(6, 8)) if rng.random() < 0.5 else rng.choice(OTHER_WORDS) + rng.choice(COMMON) + word() + "ation", "bearer"),
    ]
    out = []
    for k in range(n):
        q, tail = rng.choice(["\"", "'", "", "\""]), some(rng.randint(0, 4))
        if k % 2:
            value = rng.choice(keys)()
            name = rng.choice(SECRET_WORDS)
            name = rng.choice([name, name.upper(), f"{word()}_{name}", name.title()])
            close = q
            form = rng.random()
            if form < 0.08:
                kind = rng.choice(["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "])
                rows = [pick(b64, 64) for _ in range(rng.randint(2, 25))] + [pick(b64, rng.randint(2, 60))]
                head, value, close = some(rng.randint(0, 4)) + " ", f"-----BEGIN {kind}PRIVATE KEY-----\n" + "\n".join(rows) + f"\n-----END {kind}PRIVATE KEY-----", ""
            elif form < 0.16:
                value, close = value.replace("@", "a"), "@"
                head = f"{some(rng.randint(0, 3))} {rng.choice(['https', 'postgres', 'redis', 'ftp', 'mysql'])}://{word()}:"
                tail = f"{word()}.{rng.choice(['com', 'org'])}/{word()} {tail}"
            elif form < 0.26:
                value, close = pick(rng.choice([letters, string.ascii_letters, letters + "._-"]), rng.randint(20, 60)) + "x", q
                head = f"{some(rng.randint(0, 3))} {rng.choice(['Authorization: Bearer ', 'bearer ', 'Bearer '])}"
                close = ""
            elif _PREFIXED.match(value) and form < 0.6:
                head = some(rng.randint(1, 4)) + " " + q
            else:
                head = f"{some(rng.randint(0, 4))} {name}{rng.choice([' = ', '=', ': ', ' := ', '='])}{q}"
        else:
            value, name = rng.choice(others)()
            value = value if len(value) >= 6 else value + "-" + word()
            close = q
            head = f"{some(rng.randint(1, 4))} {name}{rng.choice([' ', ': ', ' = ', '=']) if name and name != 'bearer' else ' '}{q if name else ''}"
        out.append((f"{head}{value}{close} {tail}", len(head), len(head) + len(value), k % 2))
    return out


def kind_at(text: str, start: int) -> str:
    """The kind of the candidate that starts there; a token where there is none."""
    return next((kind for a, _, kind in candidates(text) if a == start), "token")


def train(findings: list[tuple[str, int, int, int]] | None = None, **named) -> Forest:
    """A forest from labelled findings (text, start, end, label); the made-up ones by default."""
    findings = labelled_findings() if findings is None else findings
    rows = [features(t, a, b, kind_at(t, a)) for t, a, b, _ in findings]
    return Forest(np.array(rows, float).reshape(-1, len(FEATURES)), np.array([y for *_, y in findings], float), **named)


_FOUND = [("start", T.LongType(), pa.int64()), ("end", T.LongType(), pa.int64()), ("kind", T.StringType(), pa.string()), ("value_sha256", T.StringType(), pa.string()), ("probability", T.DoubleType(), pa.float64())]


def findings(docs: DataFrame, forest: Forest, text_col: str = "text", into: str = "findings") -> DataFrame:
    """``docs`` with findings (in the column ``into``): an array of start, end (code points), kind, value_sha256 and probability for every candidate, in order.

    Values are named by their hash, so a report does not spread them.  Whole texts are read;
    a null or empty text has none, repeated rows equal ones.
    """
    held = small_batches(docs).sparkContext.broadcast(forest)
    kind = pa.list_(pa.struct([(n, a) for n, _, a in _FOUND]))

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField(n, t) for n, t, _ in _FOUND])))
    def scan(texts: pa.Array) -> pa.Array:
        out, rows, places = [], [], []
        for k, t in enumerate(texts):
            text = t.as_py() or ""
            out.append([])
            for a, b, kind_ in candidates(text):
                rows.append(features(text, a, b, kind_))
                places.append(k)
                out[k].append({"start": a, "end": b, "kind": kind_, "value_sha256": hashlib.sha256(text[a:b].encode()).hexdigest()})
        if rows:
            seen = Counter()
            for k, p in zip(places, held.value(np.array(rows, float)), strict=True):
                out[k][seen[k]]["probability"] = float(round(p, 12))
                seen[k] += 1
        return pa.array(out, kind)

    return without(docs, into).withColumn(into, scan(F.col(f"`{text_col}`")))


def redact(docs: DataFrame, forest: Forest, text_col: str = "text", threshold: float = 0.5, mark: str = "[secret]") -> DataFrame:
    """``docs``, its columns unchanged, with ``mark`` in place of each finding at or above the threshold.

    Null, empty and clean texts stay as they are; a finding goes whole, however long; repeated
    rows change alike; an empty table gives no rows; other columns, whatever their names, stay.
    """
    found = findings(docs.withColumn("_v_text", F.col(f"`{text_col}`")), forest, "_v_text", "_v_findings")
    secret = F.filter("_v_findings", lambda f: f["probability"] >= threshold)
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))
    step = lambda s, f: F.struct(F.concat(s["done"], F.substring(F.col("_v_text"), (s["at"] + 1).cast("int"), (f["start"] - s["at"]).cast("int")), F.lit(mark)).alias("done"), f["end"].alias("at"))
    rest = lambda s: F.concat(s["done"], F.substring(F.col("_v_text"), (s["at"] + 1).cast("int"), F.length("_v_text")))
    text = F.when(F.size(secret) > 0, F.aggregate(secret, start, step, rest)).otherwise(F.col("_v_text"))
    return found.withColumn("_v_new", text).withColumn(text_col, F.col("_v_new")).select([F.col(f"`{c}`") for c in docs.columns])
