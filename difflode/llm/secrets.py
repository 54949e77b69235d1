"""Credentials embedded in source code: locating and masking them."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Records that a word of the segmentation must occur in, and their share. With w words a record at most w / share words
#: can reach the share, whatever the corpus, so that the dictionary is bounded without leaving any such word out.
DICTIONARY_RECORDS, DICTIONARY_SHARE = 5, 1e-5

# Words of keys that hold a credential, of keys that do not although they name one, and of values that stand for one.
STRONG = {"password", "passwd", "passphrase", "passcode", "pwd", "pass", "pw", "secret", "token", "credential", "credentials", "apikey", "authtoken", "bearer", "passwort", "kennwort"}
KEY_OF = {"api", "access", "secret", "signing", "hmac", "private", "encryption", "auth", "account", "master", "shared", "storage", "service", "aes", "license", "deploy", "webhook", "session", "jwt", "crypto", "cipher", "sign", "write", "admin"}
FILLERS = re.compile(
    r"(?i)^(?:x{4,}|\*{3,}|\.{3,}|-+|_+|#+|0+|1234\d*|none|null|nil|undefined|true|false|yes|no|empty|optional|required|"
    r"todo|tbd|fixme|n/?a|secret|password|passwd|token|test|string|str|redacted|masked|hidden|removed|omitted)$|"
    r"replace|change[-_ ]?(?:me|this)|your[-_ ]|^my[-_ ]|insert[-_ ]|placeholder|dummy|example|sample[-_ ]|redacted|<[^>]*>|x{6,}|X{6,}|\*{4,}|\.\.\.|fill[-_ ]?in|not[-_ ]?set|put[-_ ]"
)
REFERENCE = re.compile(r"\$\{|\$\(|\{\{|\}\}|^\$[A-Za-z_]|^%[\w({]|^@[\w.]+@$|^#\{|env\[|env\(|environ|getenv|^vault[:./]|^secretsmanager|^ssm:|^arn:|^file:|^/run/secrets|^op://|^<%|^!Ref|^\{[\w.]*\}$|^&|^\*\w")
#: Forms that are digests or ids, not credentials, unless the key says otherwise.
HASHES = re.compile(r"^(?:sha\d{1,3}[-:=].+|md5[-:=].+|\$2[aby]\$.+|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$", re.I)
KNOWN = re.compile(
    r"(?<![A-Za-z0-9_])("
    r"(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}|sk-(?:proj-|ant-)?[A-Za-z0-9_-]{24,}|xox[abeoprs]-[A-Za-z0-9-]{12,}|gh[oprsu]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,}|"
    r"glpat-[\w-]{18,}|gl(?:rt|dt|ptt|soat)-[\w-]{18,}|npm_[A-Za-z0-9]{30,}|dop_v1_[\w-]{24,}|SG\.[\w.-]{20,}|AIza[\w-]{30,}|hf_[A-Za-z0-9]{30,}|shp(?:at|ca|pa|ss)_[A-Fa-f0-9]{24,}|"
    r"pypi-[\w-]{40,}|ya29\.[\w-]{20,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})"
)
ACCESS_ID = re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
USERINFO = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*://[^\s:/@'\"<>]*:([^\s/@'\"<>]+)@[\w\[$-]")
DASH_U = re.compile(r"(?:\s-u\s*|--user[= ])['\"]?[^\s:'\"]+:([^\s'\"]+)")
FLAG = re.compile(r"--?(?:pass(?:word|phrase|wd)?|pwd|secret|token|auth[-_]token|api[-_]?key|access[-_]token)(?:=|\s+)['\"]?([^\s'\"]+)", re.I)
DASH_P = re.compile(r"(?:--user|--username|--login|\blogin\b|-U|-u)[ =]\S+.*?\s-p\s*['\"]?([^\s'\"]+)")
CONNECTION = re.compile(r"(?:^|[;\"'\s])(?:password|pwd|(?:shared ?access|account|access|shared) ?key)\s*=\s*([^;\"'\s]+)\s*(?:;|$|[\"'])", re.I)
WEBHOOK = re.compile(r"hooks\.slack\.com/services/T\w+/B\w+/(\w{16,})")
SSHPASS = re.compile(r"\bsshpass\s+-p\s*(?:'([^']+)'|\"([^\"]+)\"|([^\s'\"]+))")
ALONE = re.compile(r"\b(?:auth|authenticate|set_?(?:password|token|secret|api_?key))\(\s*(?:b|r|u)?([\"'])((?:(?!\1).)+)\1\s*\)", re.I)
DOCKER = re.compile(r"^[+\- ]?\s*(?:ENV|ARG|setx|set)\s+([A-Za-z_]\w*)\s+[\"']?([^\s\"']+)[\"']?\s*$")
LOGIN = re.compile(r"\b(?:log_?in|authenticate|connect|auth|sign_?in|set_?credentials)\(\s*(?:\w+\s*=\s*)?([\"'])[^\"']*\1\s*,\s*(?:\w+\s*=\s*)?([\"'])((?:(?!\2).)+)\2", re.I)
NETRC = re.compile(r"\blogin\s+\S+\s+password\s+(\S+)", re.I)
PROSE = re.compile(r"\b(?:log(?:ging|ged)? ?(?:in|on)|sign(?:ing)? in|authenticate|connect)\b[^\n]{0,60}?\b(?:with|using)\s+(?:the\s+)?(?:password\s+|passphrase\s+|pw\s+)?[`'\"]?([^\s`'\"]{6,})|\bpass(?:word|phrase|wd)\s+(?:is|was|=|:)\s+[`'\"]?([^\s`'\"]{6,})", re.I)
HEADER = re.compile(r"\b(?:(?:Proxy-)?Authorization)\b[\"'\]]*\s*[:=,]\s*[\"']?(?:(?:Basic|Bearer|Token|ApiKey)\s+)?([^\s\"',;]+)", re.I)
XML = re.compile(r"<(?:\w+:)?([A-Za-z][\w.-]*)(?:\s[^<>]*)?>([^<>\s]+)</")
ADD = re.compile(r"\b(?:key|name|id)\s*=\s*([\"'])([\w.:-]+)\1\s+value\s*=\s*([\"'])([^\"']+)\3", re.I)
ASSIGN = re.compile(r"(?:^[+\-]?|[\s,{(\[;|<$?&:/.\"'])[\"']?([A-Za-z_][\w.-]*)[\"']?\]?\s*(=>|:=|=|:)(?!=|:)\s*(?:[A-Za-z][\w.<>\[\]]*\s=\s+)?")
QUOTED = re.compile(r"[rbuf]{0,2}([\"'`])((?:\\.|(?!\1).)*)\1")
CONCAT = re.compile(r"\s*(?:\+|\.|\|\|)?\s*[rbuf]{0,2}([\"'`])((?:\\.|(?!\1).)*)\1")
BARE = re.compile(r"[^\s,;\"'`]+")
#: Between the letters of a key's word, which ``holds_credential`` joins over signs.
_S = r"[^\sA-Za-z0-9]*"
#: What every line must hold that a detector can report; a line without it is not scanned. Each part names its detectors.
CANDIDATE = re.compile(
    "(?i)"
    # KNOWN, with its condition on what stands before
    r"(?<![A-Za-z0-9_])(?:[srp]k_|sk-|sg\.|hf_)|xox.-|gh[oprsu]_|github_pat_|gl(?:pat|rt|dt|ptt|soat)-|npm_|dop_v1|aiza|shp.._|pypi-|ya29|eyj|"
    # WEBHOOK, ACCESS_ID, PEM, USERINFO, DASH_U and DASH_P
    r"hooks\.slack|akia|asia|-----begin|://[^\s/]*@|\s-u|-u[ =]|--user|"
    # LOGIN, ALONE, PROSE, NETRC, HEADER
    r"log(?:ging|ged)?[ _]?[io]n|sign(?:ing)?[ _]?in|connect\b|auth|"
    # words of STRONG and KEY_OF: FLAG, CONNECTION, SSHPASS, DOCKER, XML, ADD, ASSIGN and the rest of LOGIN and PROSE
    + "|".join(_S.join(w) for w in ("pass", "pw", "secret", "token", "key", "cred", "bearer", "kennwort"))
)
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


class Segmenter:
    """Splits letters into dictionary words at the least cost (Viterbi); what no word explains is residual."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) + 1
        self.cost = {w: math.log(total / n) + 1.0 for w, n in counts.items() if len(w) >= 3}
        self.longest = max(map(len, self.cost), default=0)
        self.unknown = math.log(total) + 1.0
        self.known: dict[str, int] = {}

    def residual(self, letters: str) -> int:
        """How many of these lower-case letters belong to no word of the best segmentation."""
        if letters in self.known:
            return self.known[letters]
        n = len(letters)
        best = [(0.0, 0)] + [(math.inf, 0)] * n
        for i in range(1, n + 1):
            c, r = best[i - 1]
            here = (c + self.unknown, r + 1)
            for k in range(3, min(i, self.longest) + 1):
                w = self.cost.get(letters[i - k : i])
                if w is not None:
                    c, r = best[i - k]
                    here = min(here, (c + w, r))
            best[i] = here
        if len(self.known) < 100_000:
            self.known[letters] = best[n][1]
        return best[n][1]

    def unexplained(self, value: str) -> int:
        """Letters of the value outside words, and digits that stand between letters."""
        loose = sum(self.residual(x.lower()) for x in re.findall(r"[A-Za-z]+", value))
        return loose + sum(len(x) for x in re.findall(r"(?<=[A-Za-z])\d+(?=[A-Za-z])", value))


def holds_credential(key: str) -> bool:
    """Whether the last words of a key say that its value is a credential."""
    words = [w.lower() for w in CAMEL.findall(key)]
    if not words:
        return False
    last = words[-1]
    if last.isdigit() and len(words) > 1:
        words, last = words[:-1], words[-2]
    joined = "".join(words[-2:])
    if last in STRONG or joined in STRONG:
        return not (last == "token" and len(words) > 1 and words[-2] in {"next", "cancellation", "lexer"})
    return last == "key" and len(words) > 1 and words[-2] in KEY_OF


def is_literal(value: str) -> bool:
    """Whether a value is given as such: no placeholder, no reference to a variable or store."""
    return len(value) >= 6 and not FILLERS.search(value) and not REFERENCE.search(value) and len(set(value)) > 3


def is_secret(value: str, words: Segmenter, quoted: bool) -> bool:
    """Whether the value of a credential's key is one: long unexplained residuals, or words made hard with digits and case or signs."""
    if not is_literal(value) or HASHES.match(value):
        return False
    if re.search(r"\s", value) and not re.search(r"\d", value):
        return False
    if not quoted and re.search(r"[()\[\]{}]|->|::|^[\w.]+\.\w+\(|^(?:self|this)\.", value):
        return False
    loose = words.unexplained(value)
    digits, letters = sum(c.isdigit() for c in value), sum(c.isalpha() for c in value)
    signs = sum(not c.isalnum() and c not in "_." for c in value)
    mixed = any(c.isupper() for c in value) and any(c.islower() for c in value)
    if digits and letters and (loose >= 4 or mixed or signs) and len(value) >= 8:
        return True
    if loose >= 8 and letters and (quoted or loose >= 0.5 * letters):
        return True
    return bool(signs) and mixed and loose >= 4


def scan_line(line: str, words: Segmenter) -> list[tuple[int, int]]:
    """Spans of the credentials in one line, private keys and access ids apart."""
    spans: list[tuple[int, int]] = []

    def add(m: re.Match, g: int, ok: bool) -> None:
        if ok:
            spans.append(m.span(g))

    for m in KNOWN.finditer(line):
        add(m, 1, not FILLERS.search(m[1]) and len(set(m[1])) > 8)
    for m in USERINFO.finditer(line):
        add(m, 1, is_literal(m[1]))
    for m in DASH_U.finditer(line):
        add(m, 1, is_literal(m[1]))
    for m in FLAG.finditer(line):
        add(m, 1, is_secret(m[1], words, True))
    for m in DASH_P.finditer(line):
        add(m, 1, is_secret(m[1], words, True))
    for m in CONNECTION.finditer(line):
        add(m, 1, is_literal(m[1]) and not re.search(r"[()]", m[1]))
    for m in WEBHOOK.finditer(line):
        add(m, 1, len(set(m[1])) > 6 and not FILLERS.search(m[1]))
    for m in SSHPASS.finditer(line):
        g = next(i for i in (1, 2, 3) if m[i])
        add(m, g, is_secret(m[g], words, True))
    for m in ALONE.finditer(line):
        add(m, 2, is_secret(m[2], words, True))
    m = DOCKER.match(line)
    if m:
        add(m, 2, holds_credential(m[1]) and is_secret(m[2], words, False))
    for m in LOGIN.finditer(line):
        add(m, 3, is_secret(m[3], words, True))
    for m in NETRC.finditer(line):
        add(m, 1, is_literal(m[1]))
    for m in PROSE.finditer(line):
        g = 1 if m[1] else 2
        add(m, g, is_secret(m[g].rstrip(".,;)"), words, False))
    for m in HEADER.finditer(line):
        add(m, 1, is_secret(m[1], words, True) and len(m[1]) >= 12)
    for m in XML.finditer(line):
        add(m, 2, holds_credential(m[1]) and is_secret(m[2], words, True))
    for m in ADD.finditer(line):
        add(m, 4, holds_credential(m[2]) and is_secret(m[4], words, True))
    for m in ASSIGN.finditer(line):
        if not holds_credential(m[1]):
            continue
        q = QUOTED.match(line, m.end())
        if q:
            parts, at = [q], q.end()
            while (c := CONCAT.match(line, at)) and c.end() > at:
                parts.append(c)
                at = c.end()
            if is_secret("".join(p[2] for p in parts), words, True) and re.match(r"\s*(?:[;,)}\]#/]|/\*|$|\\n|\s)", line[at:] + " "):
                spans.extend(p.span(2) for p in parts if p[2])
            continue
        b = BARE.match(line, m.end())
        if b and re.fullmatch(r"\s*[;,]?\s*(?:(?:#|//).*)?", line[b.end() :]) and is_secret(b[0], words, False):
            spans.append(b.span())
    return spans


def scan(text: str, words: Segmenter) -> list[tuple[int, int, int]]:
    """``(line_no, start, end)`` of all credentials of a text; offsets are in the text, lines count from 1."""
    if not text or not CANDIDATE.search(text):
        return []
    found: list[tuple[int, int, int]] = []
    lines = text.split("\n")
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    ids, i = [], 0
    while i < len(lines):
        line = lines[i]
        if not CANDIDATE.search(line):
            i += 1
            continue
        pem = PEM.search(line)
        if pem:
            body = [(i, pem.end(), len(line.rstrip("\r")))] if re.match(r"(?:\\n|\s)*[A-Za-z0-9+/=]{16,}", line[pem.end() :]) else []
            j, closed = i + 1, bool(PEM_END.search(line, pem.end()))
            while not closed and j < len(lines):
                bare = re.sub(r"^[+\- ]?[\s\"'#*/|>]*", "", lines[j])
                if PEM_END.search(bare):
                    closed = True
                    break
                m = re.match(r"(?:[A-Za-z0-9+/=_]{8,}|[A-Za-z-]+: .*|[A-Za-z0-9+/=]+)(?:\\n)?[\"',+\s\\]*\r?$", bare) if bare.strip() else re.match("", "")
                if not m:
                    break
                if bare.strip():
                    s = len(lines[j]) - len(bare)
                    body.append((j, s, s + len(bare.rstrip("\r\"',+ \\"))))
                j += 1
            if body:
                if pem and closed and body[0][0] == i:
                    e = PEM_END.search(line, pem.end())
                    body[0] = (i, pem.end(), e.start() if e else len(line))
                found.extend((i + 1, starts[k] + s, starts[k] + e) for k, s, e in body)
                i = max(i + 1, j)
                continue
        for m in ACCESS_ID.finditer(line):
            if len(set(m[1])) > 8:
                ids.append((i, m.span(1)))
        found.extend((i + 1, starts[i] + s, starts[i] + e) for s, e in scan_line(line, words))
        i += 1
    if ids:
        hit = {n - 1 for n, _, _ in found}
        for k, (s, e) in ids:
            if any(x in hit for x in range(k - 4, k + 5)):
                found.append((k + 1, starts[k] + s, starts[k] + e))
    return sorted(set(found))


def mask(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each found value as asterisks of the same length; line ends and all else stay."""
    out, at = [], 0
    for _, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        s = max(s, at)
        if e > s:
            out += [text[at:s], re.sub(r"[^\n]", "*", text[s:e])]
            at = e
    return "".join([*out, text[at:]])


def dictionary(identifiers: DataFrame, col: str) -> dict[str, int]:
    """The words of an array column of identifiers that occur in enough records, with the records they occur in.

    Counted over all rows; a word must occur in ``DICTIONARY_RECORDS`` records and in
    ``DICTIONARY_SHARE`` of all. Identifiers are split at case changes, digits and signs.
    """
    spaced = F.lower(F.regexp_replace(F.regexp_replace(F.concat_ws(" ", F.col(col)), r"([a-z])([A-Z])", "$1 $2"), r"[^A-Za-z]+", " "))
    words = identifiers.select(F.explode(F.array_distinct(F.split(spaced, " "))).alias("w")).where("length(w) between 3 and 20")
    total = identifiers.agg(F.count(F.lit(1)).alias("total"))
    often = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= DICTIONARY_RECORDS).join(total, F.lit(True)).where(F.col("n") >= DICTIONARY_SHARE * F.col("total"))
    base = "the and for with from user name value data file path test type list default config server client host port http https string none null true false admin root login service example local main password secret token hint number count code line text error".split()
    return {w: 100 for w in base} | {r["w"]: r["n"] for r in often.select("w", "n").collect()}


def find_secrets(records: DataFrame, key: list[str], text: str, words: dict[str, int], masked: bool = False) -> DataFrame:
    """Rows ``key, line_no`` of the lines with a credential, or with ``masked`` rows ``key, masked_text, n`` of all records.

    Literals are cut into dictionary words; long residuals next to an assignment, header,
    address or command with a credential's name are secrets, as are known token formats
    and private keys. Digests, checksums, public keys, placeholders and references are
    not. Null and empty texts hold none (a null text stays null); texts of any length are
    scanned whole; repeated deliveries give repeated rows, which callers fold.
    """
    schema = records.select(*key).schema
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    counts = dict(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = Segmenter(counts)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            hits = [scan(t, seg) if t else [] for t in texts]
            if masked:
                cols = [batch.column(k) for k in key]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([mask(t, h) if h else t for t, h in zip(texts, hits)], pa.string()), pa.array([len({x[0] for x in h}) for h in hits], pa.int32())], names=[*key, "masked_text", "n"])
                continue
            rows = [(i, n) for i, h in enumerate(hits) for n in sorted({x[0] for x in h})]
            take = pa.array([i for i, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in key], pa.array([n for _, n in rows], pa.int32())], names=[*key, "line_no"])

    out = f"{names}, masked_text string, n int" if masked else f"{names}, line_no int"
    return records.select(*key, text).mapInArrow(run, out)
