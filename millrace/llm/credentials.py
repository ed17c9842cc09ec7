"""Problem 6: credentials embedded in source code and configuration.

A file is decoded (UTF-8, UTF-16, Latin-1) so that it can be encoded again byte for
byte. Its literals, quoted or bare, also those joined from pieces, are judged by what
their value looks like and by the names around them. What doesn't pass as it stands is
decoded: base64, hexadecimal, percent and backslash layers are peeled recursively, blobs
that come out are parsed by the grammar of key containers (DER, OpenSSH), and the text
of each layer is judged again. The span found is always that of the literal in the file
that encloses the credential, so that masking it leaves the code around it intact.

Files are read one by one within Arrow batches: nothing is shuffled, and the largest
group a task holds is one batch of files of at most 5 MiB each.
"""

from __future__ import annotations

import base64
import binascii
import re
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass
from bisect import bisect_right
from functools import cache, lru_cache
from itertools import accumulate, islice, takewhile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names by which secrets go, in lower case, words of a name apart.
SECRET_WORDS = frozenset(
    "password passwd passwort passphrase pass pwd pw secret secrets token credential credentials cred creds apikey hmac bearer auth authorization authentication "
    "unlock seed pem pat psk pin kennwort contrasena contraseña clave senha palavra wachtwoord haslo hasło parola lozinka salasana losenord lösenord sifre şifre parole heslo passe пароль 密码 パスワード motdepasse mdp passcode jwt".split()
)
# Words after which a name that ends in 'key' is no secret.
OPEN_KEYS = frozenset("public pub cache primary foreign sort partition group map row object dict index search lookup hot short arrow cursor unique natural parent column header i18n translation idempotency key".split())
# Words of a name that make it the name of something about a secret, not of the secret.
ABOUT = frozenset(
    "hash hashes hashed digest checksum sum etag integrity revision commit icon file files path dir ttl size min max length len name names ref refs from id ids count limit limits policy field fields public type kind expiry expires age "
    "timeout url uri endpoint host port user username login algorithm alg version fingerprint tokenizer tokens regex pattern label hint prompt env var required enabled rotation days".split()
)
# Texts that stand for a value that isn't there.
PLACEHOLDER = re.compile(
    r"(?ix)^(?: .*(?:change[-_ ]?me|example|placeholder|redacted|dummy|sample|insert[-_ ]|replace[-_ ]|your[-_ ]|[-_]here|todo|fixme|notreal|not[-_ ]a[-_ ]real|not[-_ ]?set|fake|xxxx|\*\*\*\*|\.\.\.|0000000|1234567|removed|masked|hidden|\bnone\b|undefined).*"
    r" | null|nil|true|false|test|secret|password|passwd|token|string|str|admin|root|default|empty|n/?a|tbd|unset|foo|bar|baz|x+|\*+|-+|_+|0+|•+|<.*>|\[.*\]|\{.*\} )$"
)
# Ways of pointing at a value kept elsewhere, or at one encrypted.
REFERENCE = re.compile(
    r"(?x)\$\{.*\} | \$\( | \{\{.*\}\} | ^\$\w+$ | ^%\w+%$ | ^%\(\w+\)s$ | ^ENC\[ | ^ENC\( | ^\{cipher\} | ^\$ANSIBLE_VAULT | ^!vault | ^vault: | ^ssm: | ^arn: | ^op:// | ^kv/ | ^secretsmanager | ^env[:.] | ^file: | ^/(?:run|etc|var|home|opt|usr)/"
    r" | ^(?:data|var|local|module|process\.env|os\.environ|env|secrets|config|settings)\. | ^~/ | ^\.{1,2}/ | ^@ | ^age1 | ^-----BEGIN\ PGP\ MESSAGE | ^AQICAH | ^gAAAAA"
)
# Hashes, checksums and identifiers.
OPEN_VALUE = re.compile(
    r"(?ix)^(?: (?:md5|sha\d*|sha3)[-:$=].* | \$(?:2[abxy]?|5|6|1|argon2\w*|scrypt|pbkdf2[\w-]*|y|7)\$.* | \{(?:s?sha\d*|s?md5|crypt|bcrypt)\}.* | pbkdf2[_:].* | scrypt: .* | [0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    r" | data:\w+/.* | (?:[0-9a-f]{2}:){7,}[0-9a-f]{2} | ssh-(?:rsa|ed25519|dss)\ .* | ecdsa-.* | v?\d+(?:[.\d]+)*(?:[-+][\w.]+)? | \d{4}-(?:w\d\d|\d\d-\d\d.*) | pk_(?:live|test)_.* )$"
)
# Forms of keys that providers hand out.
PROVIDER = re.compile(
    r"(?x)(?<![A-Za-z0-9_.-])(?: (?P<sk>sk-(?:[a-z]+-)*[A-Za-z0-9_-]{20,}) | gh[pousr]_[A-Za-z0-9]{30,} | github_pat_\w{40,} | glpat-[\w-]{18,} | npm_[A-Za-z0-9]{30,} | pypi-[\w-]{40,} | AIza[\w-]{33,37} | (?:AKIA|ASIA)[A-Z0-9]{16} | xox[abeoprs]-[\w-]{20,}"
    r" | hvn?[sb]?\.[A-Za-z0-9_-]{20,} | qlt_(?:[a-z]+_)?[A-Za-z0-9]{24,} | (?:sk|rk|whsec|sq0csp|shp(?:at|ss|ca))_(?:live_|test_)?[A-Za-z0-9]{20,} | SG\.[\w-]{20,}\.[\w-]{40,} | dop_v1_[0-9a-f]{64} | hf_[A-Za-z0-9]{30,} | eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,} | AGE-SECRET-KEY-1[A-Z0-9]{50,} )(?![A-Za-z0-9_])"
)
PEM = re.compile(r"-----BEGIN (?!ENCRYPTED)(?:[A-Z0-9]+ )*?PRIVATE KEY(?: BLOCK)?-----")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*?PRIVATE KEY(?: BLOCK)?-----")
URL = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"'`<>]*:(?P<pw>[^\s/\"'`<>]+)@[\w.\[\]{}$%-]")
HEX_KEY = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{48}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})|(?:[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{48}|[0-9A-F]{64})")
AUTH = re.compile(r"(?i)\b(?P<scheme>basic|bearer|token|apikey)\s+(?P<v>[A-Za-z0-9+/_.=~-]{8,})")
STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`")
NAME = re.compile(r"[^\W\d][\w]*(?:[-.][^\W\d][\w]*)*")
WORD = re.compile(r"[^\W\d_]+|\d+")
CAMEL = re.compile(r"([a-z0-9])([A-Z])|([A-Z]+)([A-Z][a-z])")


@lru_cache(maxsize=100_000)
def is_secret_name(name: str) -> bool:
    """Whether a value by this name would be a secret: a secret word, or '... key', and no word that makes it something about one."""
    spaced = CAMEL.sub(lambda m: f"{m[1]} {m[2]}" if m[1] else f"{m[3]} {m[4]}", name)
    words = [w.lower() for w in WORD.findall(spaced)]
    if not words or words[-1] in ABOUT or words[-1] == "tokens":
        return False
    if any(w in ("hash", "digest", "checksum", "public", "pub") for w in words):
        return False
    joined = "".join(words)
    if "motdepasse" in joined or "passphrase" in joined or "privatekey" in joined or "apikey" in joined:
        return True
    if words[-1] == "key" or words[-1] == "keys":
        return len(words) > 1 and words[-2] not in OPEN_KEYS
    return any(w in SECRET_WORDS or w.endswith(("password", "passwd", "passwort", "secret")) for w in words)


def _mixed(v: str) -> int:
    return sum(bool(re.search(p, v)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))


def is_void(v: str) -> bool:
    """Placeholders, references, hashes and other values that let nobody in."""
    v = v.strip()
    return len(v) < 4 or bool(PLACEHOLDER.match(v) or REFERENCE.search(v) or OPEN_VALUE.match(v)) or len(set(v)) < 4


@lru_cache(maxsize=100_000)
def is_random(v: str) -> bool:
    """A long literal without the structure of words, paths or numbers."""
    if len(v) < 16 or not re.fullmatch(r"[A-Za-z0-9+/_.~=-]+", v) or is_void(v):
        return False
    if re.fullmatch(r"[0-9a-fA-F]+", v):
        return False
    if not (re.search("[a-z]", v) and re.search("[A-Z]", v) and re.search("[0-9]", v)):
        return False
    parts = [p for p in re.split(r"[/_.~=-]", v) if p]
    wordy = sum(len(p) for p in parts if re.fullmatch(r"[A-Za-z]?[a-z]+|[A-Z]+|\d{1,4}", p))
    return wordy < 0.6 * len(v)


def is_hex_key(v: str) -> bool:
    """As long as keys are, in hexadecimal. A commit or a checksum looks the same, so the names around must speak for it."""
    return bool(HEX_KEY.fullmatch(v)) and len(set(v.lower())) >= 8


@lru_cache(maxsize=100_000)
def is_password(v: str) -> bool:
    """A word made up to be typed, as people choose them: kinds of characters mixed, no path, number or identifier."""
    if not 7 <= len(v) <= 200 or re.search(r"\s", v) or is_void(v):
        return False
    if re.fullmatch(r"[A-Za-z0-9_.-]*/[\w./-]*", v) and not is_random(v):  # a path
        return False
    if re.fullmatch(r"[\w-]+\.(?:py|js|ts|tsx|mjs|go|java|json|ya?ml|md|sh|tf|sql|xml|txt|pem|key|crt|internal|example|invalid|com|org|net|io)", v):
        return False
    if re.fullmatch(r"[a-z_]+[A-Za-z_]*(?:\.[a-z_]+[A-Za-z_]*)+", v):  # attribute access
        return False
    if re.search(r"[(){}\[\]<>;,|\"'`]", v) or re.search(r"%[sdvr]|\$\d", v):
        return False
    if re.fullmatch(r"[A-Z][A-Z0-9_]*|[a-z]+(?:[A-Z][a-z]+)+|[a-z]+(?:[-_.][a-z]+)*|[a-z]+\d{1,4}|[A-Z][a-z]+(?:[A-Z][a-z]+)*|[a-z]+[-_][a-z]+\d?", v):  # constants, identifiers, plain words
        return False
    return _mixed(v) >= 2


# --- layers of encoding ---------------------------------------------------------


def _printable(raw: bytes) -> str | None:
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and all(c.isprintable() or c in "\r\n\t" for c in text) else None


def der_kind(raw: bytes) -> str | None:
    """'private' or 'public', read by the grammar of DER and of OpenSSH's container; None for anything else."""
    if raw.startswith(b"openssh-key-v1\0"):
        return "private"

    def element(at: int) -> tuple[int, int, int] | None:
        if at + 2 > len(raw):
            return None
        tag, n, at = raw[at], raw[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(raw):
                return None
            n, at = int.from_bytes(raw[at : at + k], "big"), at + k
        return (tag, at, at + n) if at + n <= len(raw) else None

    outer = element(0)
    if not outer or outer[0] != 0x30 or outer[2] < len(raw) - 2 or len(raw) < 32:
        return None
    inner, at = [], outer[1]
    while at < outer[2]:
        e = element(at)
        if not e:
            return None
        inner.append(e)
        at = e[2]
    tags = [t for t, _, _ in inner]
    version = raw[inner[0][1] : inner[0][2]] if tags and tags[0] == 0x02 else None
    if version in (b"\0", b"\1") and (tags[1:3] == [0x30, 0x04] or tags[1:2] == [0x04] or len(tags) in (6, 9) and set(tags) == {0x02}):
        return "private"  # PKCS 8, SEC 1, PKCS 1 and DSA
    if version == b"\3" and tags[1:2] == [0x30]:
        return "private"  # PKCS 12
    if tags in ([0x30, 0x03], [0x30, 0x30, 0x03]):
        return "public"  # a public key, a certificate
    return None


def peel(v: str) -> Iterator[tuple[str, bytes]]:
    """The layers that ``v`` can be read through once, by name.

    A sign escaped more than eight times over (%2525...) is read through all of these at once.
    """
    if "%25252525" in v:
        v = re.sub(r"%(?:25){8,}(?=[0-9A-Fa-f]{2})", "%", v)
    if "#38;#38;" in v:
        v = re.sub(r"&(?:#38;){8,}(?=#)", "&", v)
    if "x5cx5c" in v or "x5Cx5C" in v:
        v = re.sub(r"\\(?:x5[Cc]){8,}(?=x[0-9A-Fa-f]{2})", r"\\", v)
    if re.search(r"\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|[0-7]{3})", v):
        out = re.sub(r"\\x([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\([0-7]{3})", lambda m: chr(int(m[1] or m[2], 16) if m[1] or m[2] else int(m[3], 8)), v)
        yield "escape", out.encode("utf-8", "surrogatepass")
    if re.search(r"&#(?:x[0-9A-Fa-f]+|\d+);", v):
        yield "entity", re.sub(r"&#(?:x([0-9A-Fa-f]+)|(\d+));", lambda m: chr(min(0x10FFFF, int(m[1], 16) if m[1] else int(m[2]))), v).encode("utf-8", "surrogatepass")
    if re.search(r"%[0-9A-Fa-f]{2}", v):
        yield "percent", urllib.parse.unquote_to_bytes(v)
    bare = v.removeprefix("0x")
    if len(bare) >= 16 and len(bare) % 2 == 0 and re.fullmatch(r"[0-9A-Fa-f]+", bare):
        yield "hex", bytes.fromhex(bare)
    if len(v) >= 12 and re.fullmatch(r"[A-Za-z0-9+/_-]+={0,2}", v):
        body = v.rstrip("=").replace("-", "+").replace("_", "/")
        if len(body) % 4 != 1:
            try:
                yield "base64", base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
            except binascii.Error:
                pass


@lru_cache(maxsize=100_000)
def hidden(v: str, secret: bool) -> bool:
    """Whether a layer below ``v``, however deep, holds a credential. ``secret``: the names around ``v`` are those of secrets.

    Every layer is shorter than what it is read from, so the peeling ends.
    """
    seen, todo = {v}, [v]
    while todo:
        outer = todo.pop()
        for layer, raw in peel(outer):
            if layer in ("base64", "hex") and der_kind(raw) == "private":
                return True
            text = _printable(raw)
            if text is None or text == outer:
                continue
            text = text.strip()
            if is_strong(text):
                return True
            pair = re.fullmatch(r"[\w.@+-]*:([^\s:/][^\s]*)", text)
            if layer != "percent" and pair and not is_void(pair[1]) and len(pair[1]) >= 6 and (secret or is_password(pair[1])):
                return True
            if layer in ("base64", "hex") and len(text) >= 6 and not is_void(text) and (is_random(text) or secret and is_password(text)):
                return True
            if layer in ("escape", "entity", "percent") and secret and (is_random(text) or is_password(text)):
                return True
            if text not in seen:
                seen.add(text)
                todo.append(text)
    return False


def is_layered(v: str, secret: bool) -> bool:
    """Whether digits alone, which by themselves would be a number or version, are a credential written out in hexadecimal more than once."""
    return len(v) >= 24 and v.isdigit() and hidden(v, secret)


def is_strong(v: str) -> bool:
    """A credential by its form alone, whatever it is called."""
    m = PROVIDER.search(v)
    if m and not PLACEHOLDER.match(m[0]) and not re.search(r"(?i)example|x{6,}", m[0]) and len(set(m[0][4:])) > 6:
        return True
    if any(has_body(v[m.end() :]) for m in PEM.finditer(v)):
        return True
    m = URL.search(v)
    if m and not is_void(urllib.parse.unquote(m["pw"])) and not re.fullmatch(r"[A-Za-z]{1,8}", m["pw"]):
        return True
    m = AUTH.search(v)
    return bool(m and m.start() == 0 and m.end() == len(v.rstrip()) and is_authorization(m))


# --- private keys -----------------------------------------------------------------

# What may stand around the base64 of a key: quotes, operators, comment signs, line breaks written out.
_FRAME = r"(?:\\+[nrt]|[\s#/*;\"'`+,\\|>.&<()\[\]!-]|(?<![A-Za-z0-9])[rbuf](?=[\"'`]))*+"
_OWN_FRAME = re.compile(_FRAME)
_BODY_LINE = re.compile(rf"{_FRAME}(?:[A-Za-z0-9+/=]++(?:(?=\s*[\"'`\\]){_FRAME}[A-Za-z0-9+/=]++)*+{_FRAME})?")
_HEADER_LINE = re.compile(rf"{_FRAME}(?P<k>[A-Za-z][A-Za-z-]*): ")
_BODY_PART = re.compile(r"\\+[nrt]|[rbuf](?=[\"'`])|[A-Za-z0-9+/=]+")
_NO_KEY = re.compile(r"(?i)\.\.\.|example|redacted|placeholder|\*\*\*\*|xxxx")


def has_body(text: str) -> bool:
    """Whether the text after a key's header holds its body."""
    body = re.sub(r"\\+[nrt]|\s", "", text)
    return bool(re.search(r"[A-Za-z0-9+/]{16,}", body)) and not _NO_KEY.search(body[:200])


def key_block(lines: list[str], k: int, at: int) -> tuple[int, int, bool] | None:
    """Where the private key ends whose header ends at ``at`` in line ``k`` (from 0): line, column and whether an END line closes it; None if no key follows.

    Between header and body there may be lines of the form 'Name: value'. Lines are read
    as far as they can belong to the block, so each may be quoted, commented or continued.
    """
    tail = lines[k][at:].rstrip("\r")
    same = PEM_END.search(tail)
    if same:
        return (k, at + same.end(), True) if has_body(tail[: same.start()]) else None
    if re.search(r"[A-Za-z0-9+/]{16,}", re.sub(r"\\+[nrt]|\s", "", tail)):
        if not has_body(tail):
            return None
        body = tail
    elif _OWN_FRAME.fullmatch(tail):
        body = ""
    else:
        return None
    last, closed, column = k, False, len(lines[k])
    parts, n, long = [body], k, k
    while (n := n + 1) < len(lines):
        line = lines[n].rstrip("\r")
        end = PEM_END.search(line)
        if end:
            line = line[: end.start()]
        header = None if any(parts) or end else _HEADER_LINE.match(line)
        if header and not is_secret_name(header["k"]):
            continue
        if not _BODY_LINE.fullmatch(line):
            if n <= k + 2 and not PEM.search(line):
                parts.append(line)  # may say that this is no key
            break
        part = "".join(x for x in _BODY_PART.findall(line) if x[0] != "\\" and re.search("[A-Za-z0-9=]", x) and not (len(x) == 1 and x in "rbuf"))
        if part:
            parts.append(part)
            if n == long + 1 or len(part) >= 16:
                last, column = n, len(line)
            if len(part) >= 16:
                long = n
        if end:
            last, column, closed = n, end.end(), True
            break
    body = "".join(parts)
    if not re.search(r"[A-Za-z0-9+/]{16,}", body) or _NO_KEY.search(body[:200]):
        return None
    if _is_public(body):
        return None
    if tail.strip() and last > k and not all(re.search(c, body) for c in ("[a-z]", "[A-Z]", "[0-9]")):
        return None  # a list of markers
    return (last, column, closed) if last > k or parts[0] else None


def _is_public(body: str) -> bool:
    """Whether the body is a container that by its grammar holds a public key or a certificate only."""
    try:
        return der_kind(base64.b64decode(body.rstrip("=") + "=" * (-len(body.rstrip("=")) % 4), validate=True)) == "public"
    except binascii.Error:
        return False


def mask_body(text: str) -> str:
    """The base64 of a key's body masked; quotes, operators, comment signs and written-out line breaks stay."""
    return _BODY_PART.sub(lambda m: m[0] if m[0][0] == "\\" or not re.search("[A-Za-z0-9=]", m[0]) or len(m[0]) == 1 and m[0] in "rbuf" else "*" * len(m[0]), text)


# --- literals of a line -----------------------------------------------------------


@dataclass(frozen=True)
class Span:
    line: int
    start: int
    end: int
    kind: str


# Commands and grants in which a password stands at a place of its own; the value is the group v.
PLACES = [
    re.compile(p)
    for p in (
        r"(?i)\bidentified\s+by\s+(?:password\s+)?(?P<q>['\"])(?P<v>[^'\"]+)(?P=q)",
        r"(?i)\bpassword\s+(?P<q>['\"])(?P<v>[^'\"]+)(?P=q)",
        r"\becho\s+(?:-n\s+)?(?P<q>['\"]?)(?P<v>[^\s'\"|]+)(?P=q)\s*\|\s*(?:sudo\s+-S|docker\s+login|passwd|chpasswd|openssl)\b",
        r"\bsshpass\s+-p\s*(?P<q>['\"]?)(?P<v>[^\s'\"]+)(?P=q)",
        r"\b(?:curl|wget|http)\b[^\n]*?\s(?:-u|--user)[\s=]+(?P<q>['\"]?)[\w.@+-]+:(?P<v>[^\s'\"]+)(?P=q)",
        r"\b(?:mysql|mysqldump|mariadb)\b[^\n]*?\s-p(?P<q>['\"]?)(?P<v>[^\s'\"]+)(?P=q)",
        r"\bdocker\s+login\b[^\n]*?\s-p[\s=]*(?P<q>['\"]?)(?P<v>[^\s'\"]+)(?P=q)",
        r"\bmachine\s+\S+\s+login\s+\S+\s+(?:account\s+\S+\s+)?password\s+(?P<v>\S+)",
        r"^\s*password\s+(?P<v>\S+)\s*$",
        r"^(?!\s*[#;])[\w.*-]+:(?:\d+|\*):[\w*-]+:[\w*-]+:(?P<v>(?:[^:\\\s]|\\.)+)\s*$",
        r"(?i)\b(?:log_?in|sign_?in|authenticate|auth)\w*\(\s*(?P<p>['\"])[\w.@-]+(?P=p)\s*,\s*(?P<q>['\"])(?P<v>[^'\"]+)(?P=q)",
        r"(?i)[;?&]\s*(?:password|pwd|passwd|pw|secret|token|access_token|api_key|apikey)=(?P<v>[^\s;&\"'`<>]+)",
    )
]
PAIR = re.compile(r"(?P<k>[^\W\d][\w.\-]*)[\"'\]]*\s*(?::=|=>|=|:)\s*(?P<v>[^\s\"'`=:][^\s\"'`]*)")
LABEL = re.compile(r"^[\s>*#;/|-]*(?P<k>[^\W\d][\w-]*(?: [\w-]+){1,4})\s*[:=]\s*(?P<v>[^\s\"'`]+)\s*$")
FLAG = re.compile(r"(?<![\w-])--?(?P<k>[A-Za-z][\w-]+)[ =](?P<v>[^\s\"'`-][^\s\"'`]*)")
ELEMENT = re.compile(r"<(?P<k>[^\W\d][\w.-]*)(?:\s[^<>]*)?>\s*(?P<v>[^<>\s][^<>]*?)\s*</(?P=k)>")
OPENED = re.compile(r"(?:[:=]\s*(?:[|>][-+]?\d?)?|\(|\\|[:=]\s*\(|\[|\+)\s*$")
ALONE = re.compile(r"^\s*(?:[-+]\s*)?[rbuf]?(?P<q>[\"'`]?)(?P<v>[^\s\"'`]+)(?P=q)\s*[,;)\\+]*\s*$")
PIECE = re.compile(r"^\s*(?:\+\s*)?[rbuf]?(?P<q>[\"'`])(?P<v>[^\"'`]+)(?P=q)\s*[,+\\)]?\s*;?\s*$")
DATA_BLOCK = re.compile(r"^(\s*)(?:data|stringData|binaryData)\s*:\s*$")
DATA_ITEM = re.compile(r"^\s*[\"']?[\w.-]+[\"']?\s*:\s*[\"']?(?P<v>[A-Za-z0-9+/]{8,}={0,2})[\"']?\s*$")
DECODER = re.compile(r"(?i)atob|b64decode|base64|fromhex|unhexlify|Buffer\.from|decode|unescape|unquote|hex\.|hex\(|DecodeString|decodeURIComponent")


#: What a line must hold to be worth a closer look: part of a secret's name, of a place where passwords stand, of a provider's form or a decoder, in lower case; or the forms below. Everything that can be found holds one.
_STEMS = (
    "pass parol părol pw secret token cred key hmac bearer basic auth unlock seed pem pat psk pin kennwort contrase clave senha palavra wachtwoord haslo hasło lozinka salasana losenord lösenord sifre şifre heslo пароль 密码 パスワード mdp jwt "
    ":// identified ssh curl wget http mysql mariadb docker machine echo login log_in sign "
    "sk- ghp_ gho_ ghu_ ghs_ ghr_ github_pat glpat- npm_ pypi- aiza akia asia xox hvn. hvs. hvb. hv. hvns. hvnb. hvn qlt_ sk_ rk_ whsec sq0csp shpat shpss shpca sg. dop_v1 hf_ eyj "
    "atob b64 base64 fromhex unhex buffer.from decode unescape unquote hex. hex( join( concat("
).split()
_FORMS = re.compile(r":(?:\d+|\*):|[\"'`][^\s\"'`]{16,}|[\"'`][ \t]*(?:\+|\.\.?|\|\||&|<>)?[ \t]*[rbuf]?[\"'`]|\\[xu0-7]|%[0-9A-Fa-f]{2}|&#")


@cache
def _stems():
    import ahocorasick

    a = ahocorasick.Automaton()
    for x in _STEMS:
        a.add_word(x, len(x))
    a.make_automaton()
    return a


def promising(text: str, starts: list[int]) -> set[int]:
    """The lines (from 0, beginning at ``starts``) that hold a stem or a form."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer would shift the places
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    out, upto = set(), -1
    for at, _ in _stems().iter(low):
        if at > upto:
            k = bisect_right(starts, at) - 1
            out.add(k)
            upto = starts[k + 1] - 1 if k + 1 < len(starts) else len(text)
    upto = -1
    for m in _FORMS.finditer(text):
        if m.start() > upto:
            k = bisect_right(starts, m.start()) - 1
            out.add(k)
            upto = starts[k + 1] - 1 if k + 1 < len(starts) else len(text)
    return out


# Beginnings of the forms that providers hand out; the whole forms are tried only where one stands.
_PROVIDER_GATE = re.compile(r"sk-|gh[pousr]_|github_pat_|glpat-|npm_|pypi-|AIza|AKIA|ASIA|xox|hv|qlt_|[sr]k_|whsec_|sq0csp_|shp|SG\.|dop_v1_|hf_|eyJ|AGE-SECRET")
_PLACE_GATE = re.compile(r"(?i)identified|password|sshpass|curl|wget|http|mysql|mariadb|docker|machine|echo|log_?in|sign|auth|[;?&]|:(?:\d+|\*):")


def _names(text: str) -> list[str]:
    return NAME.findall(text)


def _strings(line: str) -> list[tuple[int, int, str]]:
    """Quoted literals (start, end of the contents, value); pieces joined by operators or only commas in a list become one."""
    found = [(m.start() + 1, m.end() - 1, m[0][1:-1]) for m in STRING.finditer(line)]
    out: list[tuple[int, int, str]] = []
    for s, e, v in found:
        if out:
            between = line[out[-1][1] + 1 : s - 1]
            join = re.fullmatch(r"\s*(?:\+|\.\.?|\|\||&|<>)?\s*[rbuf]?", between) or re.fullmatch(r"\s*,\s*", between) and re.search(r"\]\s*\.join\(|\.join\(\s*[\[(]|''\.join|\"\"\.join|strings\.Join|concat\(|String\.join", line)
            if join:
                out[-1] = (out[-1][0], e, out[-1][2] + v)
                continue
        out.append((s, e, v))
    return out


def is_authorization(m: re.Match) -> bool:
    v = m["v"]
    return not is_void(v) and (is_random(v) or is_hex_key(v) or m["scheme"].lower() == "basic" and hidden(v, True))


def is_placed(v: str) -> bool:
    """Whether what stands at a password's place is one."""
    return not is_void(v) and (is_password(v) and not is_hex_key(v) or is_random(v) or is_strong(v) or is_hex_key(v) and len(v) != 40 or hidden(v, True))


def scan_line(line: str, around: str, number: int) -> list[Span]:
    """The credentials of one line. ``around``: lines before it whose names belong to its value, '' if there are none."""
    out: list[Span] = []
    taken: list[tuple[int, int]] = []

    def add(start: int, end: int, kind: str) -> None:
        if not any(s < end and start < e for s, e in taken):
            taken.append((start, end))
            out.append(Span(number, start, end, kind))

    for m in PROVIDER.finditer(line) if _PROVIDER_GATE.search(line) else ():
        if is_strong(m[0]):
            add(m.start(), m.end(), "provider")
    for m in URL.finditer(line) if "://" in line else ():
        if is_strong(m[0]):
            add(m.start("pw"), m.end("pw"), "url")
    low = line.lower()
    for m in AUTH.finditer(line) if "bearer" in low or "basic" in low or "token" in low or "apikey" in low else ():
        if is_authorization(m):
            add(m.start("v"), m.end("v"), "authorization")
    strings = _strings(line)
    rest = line
    for s, e, _ in reversed(strings):
        rest = rest[:s] + " " * (e - s) + rest[e:]
    labels = [n for _, _, v in strings if len(v) <= 60 and re.fullmatch(r"[\w .\-]+", v) for n in [v]]
    secret = any(map(is_secret_name, _names(rest))) or bool(around) and any(map(is_secret_name, _names(around)))
    prose = re.search(r"`[^`]+`\s+as\s+the\s+([\w ]+)", line) if "`" in line else None
    if prose and not secret:
        secret = is_secret_name(prose[1].strip())
    decodes = bool(strings) and bool(DECODER.search(rest))
    for k, (s, e, v) in enumerate(strings):
        named = secret or any(n != v and is_secret_name(n) for n in labels)
        joined = e - s != len(v)
        coded = decodes
        if is_strong(v):
            add(s, e, "literal")
        elif is_void(v):
            if is_layered(v, named or coded or joined):
                add(s, e, "encoded")
        elif (named or joined) and (is_random(v) or is_hex_key(v)):
            add(s, e, "random")
        elif coded and is_hex_key(v) and re.search(r"(?i)key|login|secret|sign", rest):
            add(s, e, "encoded")
        elif named and is_password(v) and v not in labels_of(strings, k, rest):
            add(s, e, "password")
        elif (named or coded or joined) and hidden(v, named or coded):
            add(s, e, "encoded")
        elif len(v) >= 16 and hidden(v, False):
            add(s, e, "encoded")
    for p in PLACES if _PLACE_GATE.search(line) else ():
        for m in p.finditer(line):
            v = m["v"].rstrip(",;)")
            if is_placed(v):
                add(m.start("v"), m.start("v") + len(v), "place")
    forms = [PAIR] * (":" in rest or "=" in rest) + [FLAG] * ("-" in rest) + [ELEMENT] * ("</" in rest) + [LABEL] * (":" in rest or "=" in rest)
    bare = [(m["k"], m.start("v"), m["v"]) for r in forms for m in r.finditer(rest)]
    for key, s, v in bare:
        if line[s : s + len(v)] != v:
            continue
        v = v.rstrip(",;") if not v.endswith(";;") else v
        named = is_secret_name(key) or key.lower() in ("value", "val", "default") and bool(around) and any(is_secret_name(n) for n in _names(around))
        if named and is_layered(v, True) or named and not is_void(v) and (is_random(v) or is_hex_key(v) or is_password(v) or is_strong(v) or hidden(v, True)):
            add(s, s + len(v), "bare")
    alone = ALONE.match(line)
    if alone and around and any(is_secret_name(n) for n in _names(around)):
        v = alone["v"]
        if is_layered(v, True):
            add(alone.start("v"), alone.end("v"), "continued")
        elif not is_void(v) and not v.endswith(":") and not re.match(r"[A-Za-z_][\w.-]*[=:]", v) and (is_random(v) or is_hex_key(v) or is_password(v) or hidden(v, True)):
            add(alone.start("v"), alone.end("v"), "continued")
    return out


def labels_of(strings: list[tuple[int, int, str]], k: int, rest: str) -> set[str]:
    """Literals that are names themselves: followed by ':' or ']' or the first of several arguments."""
    s, e, v = strings[k]
    after = rest[e + 1 : e + 4].lstrip()
    return {v} if after[:1] in (":", "]") and not after.startswith(("];", "])")) else set()


def joined_spans(run: list[re.Match], number: int) -> list[Span]:
    """The credentials within a literal in pieces that no single piece holds whole; the first piece of each is of the kind 'pieces'."""
    whole = "".join(m["v"] for m in run)
    starts = list(accumulate((len(m["v"]) for m in run[:-1]), initial=0))
    first = lambda at: bisect_right(starts, at) - 1
    found: list[tuple[int, int]] = []

    def add(m: re.Match, start: int, end: int) -> None:
        if first(m.start()) != first(m.end() - 1) and not any(s < end and start < e for s, e in found):
            found.append((start, end))

    for m in PROVIDER.finditer(whole):
        if is_strong(m[0]):
            add(m, m.start(), m.end())
    for m in URL.finditer(whole) if "://" in whole else ():
        if is_strong(m[0]):
            add(m, *m.span("pw"))
    for m in AUTH.finditer(whole):
        if is_authorization(m):
            add(m, *m.span("v"))
    for m in PEM.finditer(whole) if "-----" in whole else ():
        if has_body(whole[m.end() :]):
            end = PEM_END.search(whole, m.end())
            add(m, m.start(), end.end() if end else len(whole))
    for p in PLACES if _PLACE_GATE.search(whole) else ():
        for m in p.finditer(whole):
            v = m["v"].rstrip(",;)")
            if first(m.start("v")) != first(m.start("v") + len(v) - 1) and is_placed(v):
                add(m, m.start("v"), m.start("v") + len(v))
    out = []
    for s, e in sorted(found):
        for k in range(first(s), first(e - 1) + 1):
            at, m = starts[k], run[k]
            out.append(Span(number + k, m.start("v") + max(s - at, 0), m.start("v") + min(e - at, len(m["v"])), "pieces" if k == first(s) else "piece"))
    return out


def hidden_whole(whole: str, run: list[re.Match], named: bool) -> bool:
    """Whether a layer below the joined value holds a credential; not if a piece by itself does, beside other text."""
    return hidden(whole, named) and not (re.search(r"\s", whole) and any(is_strong(m["v"]) or len(m["v"]) >= 16 and hidden(m["v"], False) for m in run))


_MANIFEST = re.compile(r"(?m)^\s*(?:data|stringData|binaryData)\s*:\s*$")
_OPENERS = frozenset(":=|>-+(\\[0123456789")


def scan_text(text: str) -> list[Span]:
    """All credentials of a text; ``line`` counts from 1 after splitting at LF, ``start`` and ``end`` are within the line."""
    lines = text.split("\n")
    starts = list(accumulate((len(x) + 1 for x in lines[:-1]), initial=0))
    closer = promising(text, starts)
    keys, manifests = "-----BEGIN" in text, bool(_MANIFEST.search(text))
    out: list[Span] = []
    resume = column = 0
    block = -1
    before = ["", ""]
    skip = run_end = 0  # run_end: the last line of a literal in pieces
    run_around, joined = None, []
    for number, full in enumerate(lines, 1):
        line = full[:-1] if full.endswith("\r") else full
        if number <= skip:
            continue
        opened = DATA_BLOCK.match(line) if manifests else None
        if opened:
            block = len(opened[1])
        elif block >= 0 and line.strip():
            m = DATA_ITEM.match(line)
            if len(line) - len(line.lstrip()) <= block:
                block = -1
            elif m and not is_void(m["v"]) and hidden(m["v"], True):
                out.append(Span(number, m.start("v"), m.end("v"), "manifest"))
                before = [before[1], line]
                continue
        begun = before[1][-1:] in _OPENERS and bool(OPENED.search(before[1]))
        if begun and number > run_end and number != resume and PIECE.match(line):
            run = list(takewhile(bool, (PIECE.match(x.rstrip("\r")) for x in islice(lines, number - 1, None))))
            run_end, run_around, joined = number + len(run) - 1, None, []
            if len(run) > 1 and not any(m[0].rstrip().endswith(",") for m in run[:-1]):
                whole = "".join(m["v"] for m in run)
                named = any(is_secret_name(n) for n in _names(before[1]))
                joined = joined_spans(run, number)
                if not joined and not is_void(whole) and (is_random(whole) or is_hex_key(whole) or named and is_password(whole) or hidden_whole(whole, run, named)):
                    out += [Span(number + k, m.start("v"), m.end("v"), "pieces" if k == 0 else "piece") for k, m in enumerate(run)]
                    before, skip = [before[1], line], run_end
                    continue
                out += joined
                run_around = before[1] if all(ALONE.match(m[0]) for m in run) else ""
        keyed: list[Span] = []  # private keys that begin on this line
        upto = column if number == resume else 0  # what is before belongs to a key that ends here
        begin = PEM.search(line, upto) if keys else None
        while begin:
            block_end = key_block(lines, number - 1, begin.end())
            if block_end and block_end[0] == number - 1:
                keyed.append(Span(number, begin.start(), block_end[1], "private key"))
                begin = PEM.search(line, block_end[1])
                continue
            if block_end:
                keyed.append(Span(number, begin.start(), len(line), "private key"))
                resume, column, closed = block_end[0] + 1, block_end[1], block_end[2]
                skip = resume - 1 if closed else resume
                break
            begin = PEM.search(line, begin.end())
        out += keyed
        around = ""
        if number <= run_end and run_around is not None:
            around = run_around
        elif begun and ALONE.match(line):
            around = before[1]
        elif "val" in line and re.match(r"\s*[\"']?(?:value|val)[\"']?\s*[:=]", line) and re.search(r"(?i)\b(?:name|key|id)[\"']?\s*[:=]", before[1]):
            around = before[1]
        if around or number - 1 in closer:
            taken = keyed + [s for s in joined if s.line == number]
            out += [s for s in scan_line(line, around, number) if s.start >= upto and not any(s.start < k.end and k.start < s.end for k in taken)]
        bare = line.rstrip()
        if bare:
            before = [before[1], bare]
    return out


# --- files ------------------------------------------------------------------------


def read_text(data: bytes) -> tuple[str, str, bytes]:
    """The text, its codec and its byte order mark; encoding it again with these gives ``data`` back."""
    for mark, codec in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            try:
                text = data[len(mark) :].decode(codec)
                if text.encode(codec) == data[len(mark) :]:
                    return text, codec, mark
            except UnicodeError:
                pass
    head = data[:8192]
    if len(head) >= 4 and len(data) % 2 == 0:
        even, odd = head[0::2].count(0) / (len(head) / 2), head[1::2].count(0) / (len(head) / 2)
        if max(even, odd) > 0.4 and min(even, odd) < 0.1:
            codec = "utf-16-le" if odd > even else "utf-16-be"
            try:
                text = data.decode(codec)
                if text.encode(codec) == data:
                    return text, codec, b""
            except UnicodeError:
                pass
    try:
        return data.decode("utf-8"), "utf-8", b""
    except UnicodeDecodeError:
        return data.decode("latin-1"), "latin-1", b""


# Bytes that text doesn't hold.
_CONTROLS = bytes(x for x in range(32) if x not in b"\b\t\n\v\f\r\x1b") + b"\x7f"


def is_binary(data: bytes, codec: str) -> bool:
    """Whether a file isn't text: a tenth of it or more are control characters. Single NUL bytes don't make a binary file."""
    return codec in ("utf-8", "latin-1") and (data[:4] == b"\x89PNG" or b"\0" in data[:8192] and len(data) - len(data.translate(None, _CONTROLS)) >= 0.1 * len(data))


_UNPRINTABLE = re.compile(r"[\x00-\x07\x0e-\x1a\x1c-\x1f\x7f-\x9f]")


def find(data: bytes | None) -> list[Span]:
    """The credentials of a file; none of a null or empty one.

    A binary file's whole contents may be a key container; else its lines without
    control characters are read as in any file, on the others only keys known by their form.
    """
    if not data:
        return []
    text, codec, _ = read_text(bytes(data))
    if is_binary(data, codec):
        if der_kind(bytes(data)) == "private":
            return [Span(1, 0, len(text), "container")]
        lines = text.split("\n")
        return [s for s in scan_text(text) if s.kind in ("provider", "private key") or not _UNPRINTABLE.search(lines[s.line - 1])]
    return scan_text(text)


def redact(data: bytes | None) -> bytes | None:
    """The file with each credential's literal masked by as many asterisks; all other bytes stay, and so do lines and quotes.

    A private key keeps its BEGIN and END lines and loses its body.
    """
    spans = find(data)
    if not spans:
        return data
    text, codec, mark = read_text(bytes(data))
    lines = text.split("\n")
    original = list(lines)
    for s in spans:
        line = lines[s.line - 1]
        if s.kind == "private key":
            begin = PEM.search(line, s.start)
            last, column, _ = key_block(original, s.line - 1, begin.end())
            for k in range(s.line - 1, last + 1):
                start, stop = begin.end() if k == s.line - 1 else 0, column if k == last else len(original[k])
                if k == s.line - 1 and k != last:
                    lines[k] = lines[k][:start] + mask_body(lines[k][start:])
                    continue
                end = PEM_END.search(original[k], start)
                if end and end.end() <= stop:
                    stop = end.start()
                if k > s.line - 1 and not _BODY_LINE.fullmatch(original[k][start:stop].rstrip("\r")):
                    continue  # a line of the form 'Name: value'
                lines[k] = lines[k][:start] + mask_body(lines[k][start:stop]) + lines[k][stop:]
        else:
            inside = line[s.start : s.end]
            masked = "".join(c if c in "\"'`+,\t " and s.kind in ("random", "literal", "encoded", "password") and not inside.isalnum() and c in "\"'`, \t" else "*" for c in inside)
            lines[s.line - 1] = line[: s.start] + masked + line[s.end :]
    return mark + "\n".join(lines).encode(codec)


def found(entries: DataFrame) -> DataFrame:
    """``entry_id``, ``line_no``, ``kind``: where each credential begins.

    Entries without data (links, oversized files) have none; a null ``entry_id`` is kept
    as such; copies of a file are each searched. Other columns play no part.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, s.line, s.kind) for i, data in zip(batch["entry_id"], batch["data"], strict=True) for s in find(data) if s.kind != "piece"]
            yield pd.DataFrame(rows, columns=["entry_id", "line_no", "kind"])

    return entries.where("data IS NOT NULL").select("entry_id", "data").mapInPandas(scan, "entry_id bigint, line_no bigint, kind string")


def redacted(entries: DataFrame) -> DataFrame:
    """``entry_id``, ``path``, ``data`` of every entry, the credentials in ``data`` masked and all else unchanged."""

    @F.pandas_udf("binary")
    def mask(data: pd.Series) -> pd.Series:
        return data.map(lambda d: None if d is None else redact(bytes(d)))

    return entries.select("entry_id", "path", mask("data").alias("data"))
