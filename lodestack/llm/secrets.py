"""Credentials in texts and paths: find every one, give the text back without them.

1. Literals are indexed over the whole collection: whatever stands where a credential would stand
   (after a name such as ``api_key``, in the password part of an address, after ``Bearer``, ...), with
   the owner it was seen at.  One row per literal and owner goes into the shuffle.
2. A literal that many owners share is a placeholder.  A rare one is confirmed if its structure is
   that of a credential: no reference, template, mask, hash, name or plain word.
3. Every text is scanned again for the confirmed secrets, wherever they stand, and every row of the
   result comes from there.  Sixteen characters from the middle of each secret (eight or six of a shorter
   one) go into a Bloom filter that has sixteen bits for each; texts are first tested against it, then
   joined with the secrets they may hold, and an Aho-Corasick automaton over these finds the exact places.
   A filter is broadcast, so it has a greatest size; more secrets than it can hold are sought in several
   passes over the texts, each for a share of the secrets.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.session import broadcast_if_small, materialize

#: Names after which a credential is given (English, French, German, Spanish, Portuguese, Polish, Dutch, Russian).
_NAME = (
    r"[A-Za-z0-9_.\-]*?(?:pass(?:word|wd|phrase|wort|code|key)?|pwd|pw|mot[_.\-]?de[_.\-]?passe|kennwort|contrase(?:n|ñ)a|clave|senha|has(?:l|ł)o"
    r"|wachtwoord|пароль|secret|token|apikey|credentials?"
    r"|(?:api|access|secret|private|signing|encryption|storage|account|master|auth|service|deploy|license|session|shared|client|webhook|server)[_.\-]?key)"
)
_END = r"(?![A-Za-z0-9_\-])"
#: A literal: quoted, or a run without blanks and closing characters.
_QUOTED = r"""(?:"(?P<d{0}>[^"\n]*)"|'(?P<s{0}>[^'\n]*)'|`(?P<b{0}>[^`\n]*)`|(?P<u{0}>[^\s"'`<>,;)|&]+))"""
_BEFORE = r"(?<![A-Za-z0-9])"
_BY_NAME = re.compile(
    _BEFORE + _NAME + _END + r"""["'`]?\]?(?:[ \t]*(?::=|=>|=|:)[ \t]*(?:\(|\||>-?|[rbuf](?=["']))?(?:[ \t]*\\?\r?\n[ \t]*)?|["'`]?[ \t]*,[ \t]*|\([ \t]*|[ \t]*\|[ \t]*|[ \t]*>[ \t]*|"?[ \t]+value[ \t]*=[ \t]*"""
    r"""|[ \t]*(?:\|\||\?\?)[ \t]*|[ \t]+or[ \t]+|(?:[ \t]+(?:for|of|on|at)[ \t]+\S+)?[ \t]+(?:is|was|are|ist|war|=>?)[ \t]+(?:now[ \t]+)?|[ \t]+(?:identified[ \t]+by[ \t]+)?)""" + _QUOTED.format(1),
    re.IGNORECASE,
)
_BY_FIELD = re.compile(r"""\bname[ \t]*[:=][ \t]*["']?""" + _NAME + _END + r"""["']?[ \t,]*\r?\n[ \t]*["']?value["']?[ \t]*[:=][ \t]*""" + _QUOTED.format(1), re.IGNORECASE)
_ADDRESS = re.compile(r"[a-z][a-z0-9+.\-]*:/{1,2}[^\s/:@\"'<>`]*:(?P<u1>[^\s/@\"'<>`]+)@", re.IGNORECASE)
_ESCAPED_ADDRESS = re.compile(r"%3A%2F%2F[^\s/%]*%3A(?P<u1>[^\s/]+?)%40", re.IGNORECASE)
_QUERY = re.compile(r"[?&;](?:sig|signature|key|auth|code|" + _NAME + r")=(?P<u1>[^\s&;\"'<>`]+)", re.IGNORECASE)
_SCHEME = re.compile(r"\b(?P<scheme>Bearer|Basic|Token)[ \t]+(?P<u1>[A-Za-z0-9+/=._~:\-!@#$%^*]{6,})")
_USER = re.compile(r"(?:[ \t]-u|--user)[ \t=]+[\"']?[^\s:\"']+:(?P<u1>[^\s\"']+)")
_DASH_P = re.compile(r"\b(?:sshpass|mysql|mysqldump|docker[ \t]+login|mongo|redis-cli|7z|zip)\b[^\n]*?[ \t](?:-p|-a|-P)[ \t]*" + _QUOTED.format(1))
_BY_SQL = re.compile(r"\bidentified[ \t]+by[ \t]+" + _QUOTED.format(1), re.IGNORECASE)
_CALL = re.compile(r"\b(?:connect|login|authenticate|dial|open|auth)\w*\((?:[ \t]*[\"'][^\"'\n]*[\"'][ \t]*,){2}[ \t]*" + _QUOTED.format(1) + r"[ \t]*[,)]", re.IGNORECASE)
_PRIVATE_KEY = re.compile(r"-----BEGIN (?P<kind>[A-Z0-9 ]*)PRIVATE KEY(?P<block> BLOCK)?-----(?:(?!-----BEGIN )[\s\S])*?-----END (?P=kind)PRIVATE KEY(?P=block)?-----|-----BEGIN (?P<kind2>[A-Z0-9 ]*)PRIVATE KEY-----(?:(?!-----BEGIN )[\s\S])*?-----END (?P=kind2)PRIVATE KEY-----")
#: Credentials that their own form gives away.
_ISSUED = re.compile(
    r"(?<![A-Za-z0-9])(?P<u1>gh[opsu]_[A-Za-z0-9]{30,}|github_pat_\w{22,}|glpat-[\w\-]{20,}|A[KS]IA[0-9A-Z]{16}|xox[abeoprs]-[\w\-]{16,}|AIza[\w\-]{35}|sk_(?:live|test)_\w{16,}|sk-[\w\-]{32,}"
    r"|npm_\w{30,}|hvs\.[\w\-]{20,}|eyJ[\w\-]{8,}\.[\w\-]{8,}\.[\w\-]{8,})(?![A-Za-z0-9_])"
)
_PATTERNS = (_BY_NAME, _BY_FIELD, _ADDRESS, _ESCAPED_ADDRESS, _QUERY, _SCHEME, _USER, _DASH_P, _BY_SQL, _CALL, _ISSUED)
#: In a path a literal also follows a name as the next part, and ends with the part.
_IN_PATH = re.compile(_BEFORE + _NAME + _END + r"(?:[=:/ ]|[ ]+)(?P<u1>[^\s/\\&?]+)", re.IGNORECASE)
#: ... or behind a dash in the same part, if it looks made up: ``password-Xk3!bv90``.
_BY_DASH = re.compile(r"(?:^|[/\\])(?i:" + _NAME + r")-(?P<u1>(?=[^/\\]*\d)(?=[^/\\]*[A-Z!@#$%^*])[^\s/\\&?]{8,})")
_SUFFIX = re.compile(r"\.(?:txt|md|json|jsonl|ya?ml|toml|ini|cfg|conf|csv|tsv|log|bin|dat|xml|html?|css|js|ts|py|rb|go|rs|java|c|h|cpp|cs|php|sh|sql|ps1|pem|key|pub|crt|cer|der|p12|pfx|jks|gpg|asc|env|spec|zip|gz|tar|png)$", re.IGNORECASE)

_NAME_ONLY = re.compile("^" + _NAME + r"(?:[_\-]?(?:field|name|id|key|value|path|file|url|env|var|header|type|here|placeholder|hash))?$", re.IGNORECASE)
_PLACEHOLDER = re.compile(
    r"x{5,}|\*{3,}|\.{3}|•|redacted|change[_\-]?me|placeholder|your[_\-]|_here\b|example|dummy|secret[_\-]?goes|0{8,}|1234567|abcdef"
    r"|(?<![A-Za-z0-9])(?:sample|todo|tbd|fixme|masked|hidden|removed|insert|replace|none|null|undefined|foobar|test|default|secret|password)(?![A-Za-z0-9])",
    re.IGNORECASE,
)
_REFERENCE = re.compile(r"^[$%@&]|[{}<>()\[\]]|\$\{|\$\(|%[A-Z_]+%|^(?:process|os|env|config|settings|vault|secrets?|input|self|this|args|opts|ctx|ref)[.:\[]|^(?:file|vault|ssm|arn|env|secret|ref|keyring)[:/]|^/|^\.{1,2}/|^[A-Za-z]:\\|^https?:", re.IGNORECASE)
_HASH = re.compile(r"^(?:\$(?:2[abxy]?|1|5|6|argon2\w*|pbkdf2\S*|scrypt|apr1)\$|\{?(?:SSHA|SHA|MD5|CRYPT|PBKDF2)\w*\}|pbkdf2|sha\d*[:\-]|md5[:\-]|bcrypt|scrypt|ENC\[|ENC\(|gAAAAA|AQICAH|U2FsdGVk|vault:v\d|age1|ssh-|AAAA[A-Z])", re.IGNORECASE)


def _irregular(value: str) -> bool:
    """Whether letter case changes as in random text, not as in names."""
    letters = [c.isupper() for c in value if c.isalpha()]
    if len(letters) < 10:
        return False
    changes = sum(a != b for a, b in zip(letters, letters[1:], strict=False))
    return changes >= 0.3 * len(letters) or (len(letters) >= 14 and changes >= 0.15 * len(letters) and re.search("[A-Z]{2}[a-z]|[a-z][A-Z]{2}", value) is not None)


def credible(value: str) -> bool:
    """Whether a literal has the structure of a credential."""
    if value.startswith("-----BEGIN"):
        body = re.sub(r"-----[^-]*-----|\\[nrt]|[\s\"'+#/*]", "", value)
        return len(body) >= 40 and not _PLACEHOLDER.search(value[:200].replace("\n", ""))
    if len(value) < 6 or any(c.isspace() for c in value):
        return False
    if _ISSUED.fullmatch(value):
        return not re.search("x{5,}|example", value, re.IGNORECASE)
    if _REFERENCE.search(value) or _HASH.search(value) or _NAME_ONLY.match(value) or _PLACEHOLDER.search(value):
        return False
    if re.fullmatch(r"[\d.:,/_+\-]+|[A-Z_]+|[a-z_.\-]+|v?\d+(?:\.\d+)+\S{0,4}|\d+(?:px|ms|kb|mb|gb|s|m|h|d)", value):
        return False
    if len(set(value)) < 5 or _SUFFIX.search(value):
        return False
    digit, letter = any(c.isdigit() for c in value), any(c.isalpha() for c in value)
    if digit and letter:
        return not re.fullmatch(r"[a-z]+[_\-][a-z]+[_\-]?\d{1,3}", value)
    return letter and (_irregular(value) or (any(c.isupper() for c in value) and any(c in "!@#%^&*+=~/$" for c in value)))


def _trim(value: str) -> str:
    value = re.sub(r"(?:\\[nrt\"']|[.,;:!?\\\])}\"'`])+$", "", value)
    return value[1:] if value[:1] in "\"'`(" else value


#: One of these, in lower case, stands near every literal; found by an automaton, which spares most lines the patterns.
_TRIGGERS = (
    "pass", "pwd", "pw", "kennwort", "contrase", "clave", "senha", "haslo", "hasło", "wachtwoord", "пароль", "secret", "token", "credential",
    *(a + sep + "key" for a in ("api", "access", "private", "signing", "encryption", "storage", "account", "master", "auth", "service", "deploy", "license", "session", "shared", "client", "webhook", "server") for sep in ("", "_", ".", "-")),
    "://", ":/", "%3a%2f%2f", "?sig", "&sig", ";sig", "?key=", "&key=", ";key=", "?auth=", "&auth=", "?code=", "&code=", "bearer", "basic", *(a + "-u" + b for a in " \t" for b in " \t="), "--user", "identified", "connect", "login", "authenticate", "dial", "open", "auth",
    "7z", "zip", "redis-cli", "mongo", "mysql", "docker", "gho_", "ghp_", "ghs_", "ghu_", "github_pat_", "glpat-", "akia", "asia", "xox", "aiza", "sk_live_", "sk_test_", "sk-", "npm_", "hvs.", "eyj",
)
#: Letters that patterns without letter case take for ASCII ones; without the first of them lower() keeps lengths.
_FOLDED = (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k"))
_MACHINE: list = []


def _near_triggers(text: str) -> str:
    """The lines with a trigger and the two after each; the rest can hold no literal."""
    if not _MACHINE:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for word in _TRIGGERS:
            machine.add_word(word, len(word))
        machine.make_automaton()
        _MACHINE.append(machine)
    out, line, folded = [], 0, text
    for letter, plain in () if text.isascii() else _FOLDED:
        folded = folded.replace(letter, plain)
    for end, _ in _MACHINE[0].iter(folded.lower()):
        if end < line:  # the line of the trigger before
            continue
        first = text.rfind("\n", 0, end) + 1
        cut = text.find("\n", end)
        line = stop = cut + 1 if cut >= 0 else len(text)
        for _ in range(2):
            cut = text.find("\n", stop)
            stop = cut + 1 if cut >= 0 else len(text)
        if out and first <= out[-1][1]:
            out[-1][1] = stop
        else:
            out.append([first, stop])
    return "\n".join(text[first:stop] for first, stop in out)


def literals(text: str, path: bool = False) -> set[str]:
    """Everything in ``text`` that stands where a credential would, trimmed; private keys as they are."""
    found = {m.group() for m in _PRIVATE_KEY.finditer(text)} if "PRIVATE KEY" in text else set()
    rest = _near_triggers(_PRIVATE_KEY.sub(" ", text) if found else text)
    for pattern in _PATTERNS:
        at = 0
        while m := pattern.search(rest, at):
            groups = m.groupdict()
            kind, value = next(((k, v) for k, v in groups.items() if v is not None and k != "scheme"), ("", ""))
            # a literal may itself be a name with a literal behind it: go on right after the name
            at = max(m.start() + 1, m.end() - len(value) - 1 if pattern is _BY_NAME else m.end())
            if groups.get("scheme") == "Basic":
                try:
                    if b":" not in base64.b64decode(value, validate=True):
                        continue
                except ValueError:
                    continue
            found.add(_trim(value) if kind[:1] == "u" else value)
    if path:
        for pattern in (_IN_PATH, _BY_DASH):
            found |= {_SUFFIX.sub("", m.group("u1")) for m in pattern.finditer(text)}
        found = {v.split("/")[0].split("\\")[0] if not v.startswith("-----") else v for v in found}
        found = {_SUFFIX.sub("", v) for v in found}
    return {v for v in found if v}


#: Characters of the grams; a secret has one of the greatest width that it can hold.
_WIDTHS = (16, 8, 6)
#: Bits of the filter for each gram, and how many of them a gram sets; about one other gram in 400 passes.
_BITS_EACH, _HASHES = 16, 4
#: Bits of a filter that are put together in one task.
_BLOCK = 1 << 18


def _middle(secret: str) -> str:
    width = next(w for w in _WIDTHS if len(secret) >= w)
    at = len(secret) // 2 - width // 2
    return secret[at : at + width]


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def _gram_hashes(points: np.ndarray) -> dict[int, np.ndarray]:
    """A 64-bit hash of every run of each width, from those of half the width."""
    join = lambda left, right, width: _stir(left[: max(0, len(points) - width + 1)] * np.uint64(2 * width + 1) + right[: max(0, len(points) - width + 1)])
    two = join(_stir(points), _stir(points[1:]), 2)
    four = join(two, two[2:], 4)
    eight = join(four, four[4:], 8)
    return {6: join(four, two[4:], 6), 8: eight, 16: join(eight, eight[8:], 16)}


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _gram_hash(gram: str) -> int:
    with np.errstate(over="ignore"):
        return int(_gram_hashes(_points(gram))[len(gram)].view(np.int64)[0])


def _filter_bits(hashed: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The bits that each gram sets, one array for each of the hashes."""
    step = (hashed >> np.uint64(32)) | np.uint64(1)
    for k in range(_HASHES):
        yield (_stir(hashed) + np.uint64(k) * step) & np.uint64(bits - 1)


def spans_of(text: str, machine) -> list[tuple[int, int]]:  # noqa: ANN001
    """Where the automaton's secrets stand in ``text``: whole literals only, and none inside a longer one."""
    out, covered = [], 0
    for a, b in sorted(((end - n + 1, end + 1) for end, n in machine.iter(text)), key=lambda s: (s[0], -s[1])):
        inner = b <= covered
        covered = max(covered, b)
        escaped = text[max(0, a - 2) : a] in ("\\n", "\\t", "\\r") or text[max(0, a - 3) : a].upper() in ("%3A", "%2F", "%3D")
        if not (inner or (a and text[a - 1].isalnum() and text[a].isalnum() and not escaped) or (b < len(text) and text[b].isalnum() and text[b - 1].isalnum())):
            out.append((a, b))
    return out


class SecretScan:
    """The confirmed secrets of a collection and where they stand.

    ``texts`` holds ``origin STRING, row_id BIGINT, owner STRING, text STRING`` and may hold ``at``;
    ``path_origins`` are the origins whose texts are paths.  Of rows repeated under one origin and id the one
    with the greatest ``at`` counts (ties: the greater text).  Null and empty texts hold nothing; an empty
    table gives an empty result.  A literal with blanks in it is taken for prose, whatever its name.
    """

    def __init__(self, texts: DataFrame, path_origins: tuple[str, ...] = (), *, placeholder_owners: int = 8, map_bits: int = 1 << 28):
        self.map_bits = map_bits
        at = F.col("at") if "at" in texts.columns else F.lit(None)
        rows = texts.select("origin", F.col("row_id").cast("long").alias("row_id"), "owner", "text", at.cast("timestamp").alias("at")).where("row_id is not null and text is not null and text <> ''")
        self.texts = materialize(rows.groupBy("origin", "row_id").agg(F.max(F.struct("at", "text", "owner")).alias("r")).select("origin", "row_id", F.coalesce("r.owner", F.lit("")).alias("owner"), "r.text"), "texts")
        self._secrets_of: DataFrame | None = None

        def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                out = [(o, i, w, v) for o, i, w, t in zip(*columns, strict=True) for v in sorted(literals(t, o in path_origins))]
                arrays = list(zip(*out, strict=True)) if out else [(), (), (), ()]
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds, strict=True)], names=["origin", "row_id", "owner", "literal"])

        self.literals = materialize(self.texts.mapInArrow(extract, "origin string, row_id long, owner string, literal string"), "literals")
        owners = self.literals.select("literal", "origin", "owner").distinct().groupBy("literal").agg(F.count("*").alias("owners"))
        records = self.literals.groupBy("literal").agg(F.count("*").alias("records"))
        self.index = owners.join(records, "literal")

        def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = [v for v in batch.column(0).to_pylist() if credible(v)]
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([_gram_hash(_middle(v)) for v in kept], pa.int64())], names=["secret", "gram"])

        rare = owners.where(F.col("owners") < placeholder_owners).select("literal")
        self.secrets = materialize(rare.mapInArrow(confirm, "secret string, gram long"), "secrets")

    def _filter(self, secrets: DataFrame, bits: int) -> np.ndarray:
        """The Bloom filter of the grams of ``secrets``, put together block by block in tasks; ``bits / 8`` bytes."""

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with np.errstate(over="ignore"):
                for batch in batches:
                    hashed = np.asarray(batch.column(0)).view(np.uint64)
                    at = np.unique(np.concatenate(list(_filter_bits(hashed, bits)))).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(at // _BLOCK), pa.array((at % _BLOCK).astype(np.int32))], names=["block", "at"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                block, at = np.asarray(batch.column(0)), np.asarray(batch.column(1))
                for b in np.unique(block).tolist():
                    held.setdefault(b, np.zeros(_BLOCK, bool))[at[block == b]] = True
                    for other in [x for x in held if x < b]:  # rows come sorted by block
                        yield pa.RecordBatch.from_arrays([pa.array([other], pa.int64()), pa.array([np.packbits(held.pop(other)).tobytes()])], names=["block", "bits"])
            for b, marked in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([np.packbits(marked).tobytes()])], names=["block", "bits"])

        placed = secrets.select("gram").mapInArrow(place, "block long, at int").repartition("block").sortWithinPartitions("block")
        out = np.zeros(max(bits, _BLOCK) // 8, np.uint8)
        for block, packed in placed.mapInArrow(merge, "block long, bits binary").toLocalIterator():
            out[block * _BLOCK // 8 : (block + 1) * _BLOCK // 8] = np.frombuffer(packed, np.uint8)
        return out[: bits // 8]

    def _hits(self) -> DataFrame:
        """``(origin, row_id, gram)`` of all grams in texts that pass the filter, by as many passes as filters."""
        spark, count = self.texts.sparkSession, self.secrets.count()
        passes = max(1, -(-count * _BITS_EACH // self.map_bits))
        bits = 1 << max(10, (-(-count // passes) * _BITS_EACH - 1).bit_length())
        share = lambda part: F.pmod(F.shiftrightunsigned("gram", 7), F.lit(passes)) == part
        out = None
        for part in range(passes):
            marked = spark.sparkContext.broadcast(self._filter(self.secrets.where(share(part)), bits))

            def grams(batches: Iterator[pa.RecordBatch], marked=marked) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
                with np.errstate(over="ignore"):
                    for whole in batches:
                        for start in range(0, whole.num_rows, 500):
                            batch = whole.slice(start, 500)
                            texts = batch.column(2).to_pylist()
                            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
                            found = [np.zeros((2, 0), np.int64)]
                            for hashed in _gram_hashes(_points("".join(texts))).values():
                                hit = np.arange(len(hashed))
                                for bit in _filter_bits(hashed, bits):
                                    bit = bit[hit]
                                    hit = hit[(marked.value[bit >> np.uint64(3)] >> (np.uint64(7) - (bit & np.uint64(7))).astype(np.uint8)) & 1 == 1]
                                found.append(np.stack([np.searchsorted(ends, hit, side="right"), hashed[hit].view(np.int64)]))
                            pairs = np.concatenate(found, axis=1)
                            pairs = np.unique(pairs, axis=1) if pairs.size else pairs
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs[0])), batch.column(1).take(pa.array(pairs[0])), pa.array(pairs[1])], names=["origin", "row_id", "gram"])

            hits = self.texts.select("origin", "row_id", "text").mapInArrow(grams, "origin string, row_id long, gram long").where(share(part))
            out = hits if out is None else out.union(hits)
        return out

    def _listed(self) -> DataFrame:
        """``(origin, row_id, secrets)``: the secrets whose gram a text holds."""
        if self._secrets_of is None:
            listed = self._hits().join(broadcast_if_small(self.secrets), "gram").groupBy("origin", "row_id").agg(F.collect_set("secret").alias("secrets"))
            self._secrets_of = materialize(listed, "listed")
        return self._secrets_of

    def spans(self) -> DataFrame:
        """``(origin, row_id, first, last, secret)``: every place of every confirmed secret, by code points."""

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(origin, i, a, b, text[a:b]) for origin, i, text, machine in _machines(batch) for a, b in spans_of(text, machine)]
                arrays = list(zip(*out, strict=True)) if out else [()] * 5
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds, strict=True)], names=["origin", "row_id", "first", "last", "secret"])

        located = self.texts.select("origin", "row_id", "text").join(broadcast_if_small(self._listed()), ["origin", "row_id"])
        return located.select("origin", "row_id", "text", "secrets").mapInArrow(scan, "origin string, row_id long, first long, last long, secret string")

    def occurrences(self) -> DataFrame:
        """``(origin, row_id, secret)``, distinct: every confirmed secret in every text."""
        return self.spans().select("origin", "row_id", "secret").distinct()

    def redacted(self, mark: str = "*") -> DataFrame:
        """``(origin, row_id, text)`` of every text; each character of a secret but line breaks is ``mark``.

        Only the places that :meth:`spans` gives are blanked, so the same letters inside another word stay.
        Lengths, quotes, line and column numbers stay as they were, so code still parses.
        """

        def blank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = []
                for _, _, text, machine in _machines(batch):
                    parts, last = [], 0
                    for a, b in spans_of(text, machine) if machine is not None else ():
                        parts += [text[last : max(a, last)], re.sub(r"[^\r\n]", mark, text[max(a, last) : b])]
                        last = max(b, last)
                    texts.append("".join([*parts, text[last:]]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["origin", "row_id", "text"])

        rows = self.texts.select("origin", "row_id", "text").join(broadcast_if_small(self._listed()), ["origin", "row_id"], "left")
        return rows.select("origin", "row_id", "text", "secrets").mapInArrow(blank, "origin string, row_id long, text string")


def _machines(batch: pa.RecordBatch) -> Iterator[tuple]:
    """``(origin, row_id, text, automaton)`` of each row, 500 rows sharing one automaton; None where no secret is sought."""
    import ahocorasick

    for start in range(0, batch.num_rows, 500):
        origins, ids, texts, held = (c.to_pylist() for c in batch.slice(start, 500).columns)
        machine = ahocorasick.Automaton()
        for secret in {s for secrets in held for s in secrets or ()}:
            machine.add_word(secret, len(secret))
        if len(machine):
            machine.make_automaton()
        for origin, i, text, secrets in zip(origins, ids, texts, held, strict=True):
            yield origin, i, text, machine if secrets else None
