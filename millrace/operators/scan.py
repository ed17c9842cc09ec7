"""Content rules over files: decoding, lines, findings, overrides.

All text rules are Catalyst expressions evaluated in one pass: a segment of a line gives
an array of findings, of which ``inline`` emits those that apply. Cheap tests stand
before expensive patterns. Files aren't shuffled; only findings are.
"""

from __future__ import annotations

import fnmatch
import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import masked
from ..session import Scratch, ship
from . import patterns as p
from .images import image_status

_SPLIT = r"\r\n|[\r\u000B\f\u001C-\u001E\u0085\u2028\u2029]"


def null_counts(data: Column) -> tuple[Column, Column]:
    """NUL bytes at even and at odd places of the first 8 KiB."""
    head = F.decode(F.substring(data, 1, 8192), "ISO-8859-1")
    nulls = lambda part: F.length(part) - F.length(F.replace(part, F.lit("\x00"), F.lit("")))
    return nulls(F.regexp_replace(head, r"(?s)(.).?", "$1")), nulls(F.regexp_replace(head, r"(?s).(.)?", "$1"))


def encoding(data: Column) -> Column:
    """How the text of a file is to be read: by its byte order mark, by where the NULs of its first 8 KiB lie, as 'binary' if these lie elsewhere, else as 'text'."""
    head = F.decode(F.substring(data, 1, 8192), "ISO-8859-1")
    half = F.floor(F.length(head) / 2)
    even, odd = (n / half for n in null_counts(data))
    has_null = F.instr(head, "\x00") > 0
    return (
        F.when(F.hex(F.substring(data, 1, 2)) == "FFFE", "le mark")
        .when(F.hex(F.substring(data, 1, 2)) == "FEFF", "be mark")
        .when(has_null & (half >= 2) & (odd > 0.3) & (even < 0.05), "le")
        .when(has_null & (half >= 2) & (even > 0.3) & (odd < 0.05), "be")
        .when(has_null, "binary")
        .otherwise("text")
    )


def decoded(entries: DataFrame) -> DataFrame:
    """``entries`` with ``text`` and ``looks_binary``, decoded by byte order mark, by where NULs lie, else as UTF-8 with replacements."""
    data = F.col("data")
    utf16 = lambda skip, codec: F.decode(F.substring(data, 1 + skip, 1 << 30), codec)
    clean = F.make_valid_utf8(data.cast("string"))
    x = entries.withColumn("_kind", encoding(data))
    text = (
        F.when(F.col("_kind") == "le mark", utf16(2, "UTF-16LE"))
        .when(F.col("_kind") == "be mark", utf16(2, "UTF-16BE"))
        .when(F.col("_kind") == "le", utf16(0, "UTF-16LE"))
        .when(F.col("_kind") == "be", utf16(0, "UTF-16BE"))
        .when(F.col("_kind") == "binary", F.replace(clean, F.lit("\x00"), F.lit("")))
        .otherwise(clean)
    )
    return x.withColumns({"text": text, "looks_binary": F.coalesce(F.col("_kind") == "binary", F.lit(False))}).drop("_kind")


def lines(texts: DataFrame) -> DataFrame:
    """Lines of ``text`` (``path`` and the other columns kept), counted from 1 after splitting at LF."""
    return texts.select(*[c for c in texts.columns if c != "text"], F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("line", F.col("pos") + 1).drop("pos")


def _all(pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all("seg", F.lit("(?U)" + pattern), F.lit(group))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def is_phone(raw: Column, after: Column) -> Column:
    s = F.regexp_replace(raw, r"[ \-.(]+$", "")
    d = _digits(s)
    groups = F.regexp_extract_all(s, F.lit(r"(\d+)"), F.lit(1))
    code = F.regexp_extract(d, f"^({p.CALLING_CODES})", 1)
    dotted = s.contains(".")
    return (
        (F.length(F.regexp_replace(s, r"[^(]", "")) == F.length(F.regexp_replace(s, r"[^)]", "")))
        & ~s.rlike(r"[ \-.]{2,}")
        & F.length(d).between(8, 15)
        & (code != "")
        & ((F.size(groups) == 1) | (groups[0] == code))
        & (~code.isin("1", "7") | (F.length(d) == 11) & ((code == "7") | d.rlike(r"^1[2-9]..[2-9]")))
        & (~dotted | ~s.rlike(r"[ \-]") & (F.size(groups) >= 3) & ~F.exists(F.slice(groups, F.lit(2), F.size(groups)), lambda g: F.length(g) < 2))
        & ~s.rlike(p.DATE_WITHIN)
        & ~((F.length(s) == F.length(raw)) & after.rlike(r"^:\d\d"))
    )


def luhn(digits: Column) -> Column:
    """Whether the check digit is right: from the right, every second digit counts double, less 9 above 9."""
    n = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    each = F.transform(n, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def iban_value(raw: Column) -> Column:
    """The IBAN within ``raw`` if the length of its country and the remainder by 97 are right, else null."""
    lengths = F.create_map(*[F.lit(x) for pair in p.IBAN_LENGTHS.items() for x in pair])
    compact = F.upper(F.replace(raw, F.lit(" "), F.lit("")))
    want = F.try_element_at(lengths, F.substring(compact, 1, 2))
    value = F.substr(compact, F.lit(1), want)
    turned = F.concat(F.substr(value, F.lit(5)), F.substring(value, 1, 4))
    number = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.conv(c, 36, 10).cast("int"))
    rest = F.aggregate(number, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97)
    return F.when(want.isNotNull() & (F.length(compact) >= want) & (raw.contains(" ") | (F.length(compact) == want)) & (rest == 1), value)


def email_is_open(address: Column) -> Column:
    """Addresses of examples, of hosts that take no mail, of git remotes, and file names that look like addresses."""
    low = F.lower(address)
    name, domain = F.regexp_extract(low, "^(.*)@", 1), F.regexp_extract(low, "@([^@]*)$", 1)
    suffix = F.lit(False)
    for s in p.EMAIL_SUFFIXES:
        suffix = suffix | domain.endswith(s)
    return domain.isin(p.EMAIL_DOMAINS) | suffix | name.isin(p.EMAIL_NAMES) | (name == "git") & domain.isin(p.EMAIL_GIT_HOSTS) | F.regexp_extract(domain, r"([^.]*)$", 1).isin(p.EMAIL_ENDINGS)


def _some(rule: str, values: Column) -> Column:
    """Findings of a rule, one per value, the value masked."""
    return F.transform(values, lambda v: F.struct(F.lit(rule).alias("rule"), masked(v).alias("detail")))


def _flag(rule: str, test: Column, detail: Column | str) -> Column:
    d = F.lit(detail) if isinstance(detail, str) else detail
    return F.filter(F.array(F.struct(F.lit(rule).alias("rule"), d.alias("detail"))), lambda _: F.coalesce(test, F.lit(False)))


def _any(patterns: list[str]) -> Column:
    hit = F.lit(False)
    for x in patterns:
        hit = hit | F.col("seg").rlike("(?U)" + x)
    return hit


def _when(test: Column, values: Column) -> Column:
    """The values only where a cheap test holds, so that the expensive pattern isn't tried elsewhere."""
    return F.when(test, values).otherwise(F.array().cast("array<string>"))


def _names(pattern: str) -> Column:
    """The names of the characters of a class, as the Unicode library gives them."""
    spelled = re.sub(r"\\x\{([0-9A-F]+)\}|\\u([0-9A-F]{4})", lambda m: chr(int(m[1] or m[2], 16)), pattern.rstrip("+"))
    points = [c for a, b in re.findall(r"([^\[\]])(?:-([^\]]))?", spelled) for c in range(ord(a), ord(b or a) + 1)]
    return F.create_map(*[F.lit(x) for c in points for x in (c, unicodedata.name(chr(c), "UNNAMED"))])


def _hidden(rule: str, pattern: str, right: list[str] | None = None) -> Column:
    """Findings with the code point of each hidden character of the line, after those in right company have been taken out."""
    text = F.col("text")
    for x in right or []:
        text = F.regexp_replace(text, x, "$1")
    hits = F.when(F.col("text").rlike(r"[^\x00-\x7F]"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    point = lambda c: F.concat(F.lit("U+"), F.when(F.ascii(c) < 0x1000, F.lpad(F.hex(F.ascii(c)), 4, "0")).otherwise(F.hex(F.ascii(c))), F.lit(" "), F.coalesce(F.try_element_at(_names(pattern), F.ascii(c)), F.lit("UNNAMED")))
    return F.transform(hits, lambda c: F.struct(F.lit(rule).alias("rule"), point(c).alias("detail")))


def line_findings(text_lines: DataFrame, rules: set[str] | None = None) -> DataFrame:
    """Findings of the text rules, or of those among ``rules``: the columns of ``text_lines`` but its text, and ``rule`` and ``detail``; distinct.

    Only what the rules asked for need is built: lines are cut into segments only for
    rules on segments, and patterns of other rules aren't run.

    Needs ``path``, ``line`` and ``text``. Null and empty texts give none; very long
    segments get only the rules without long-range patterns, and ``long-line``.
    """
    wanted = lambda rule: rules is None or rule in rules
    unknown = set(rules or ()) - p.RULES.keys()
    if unknown:
        raise ValueError(f"unknown rules {sorted(unknown)}")
    keys = [c for c in text_lines.columns if c != "text"]
    in_lines = {"bidi-unicode": (p.BIDI, None), "zero-width-unicode": (p.ZERO_WIDTH, p.RIGHT_JOINERS), "invisible-unicode": (p.INVISIBLE, p.RIGHT_SELECTORS), "soft-hyphen": (p.SOFT_HYPHEN, None), "unicode-tag": (p.TAGS, p.RIGHT_TAGS)}
    hidden = [_hidden(rule, pattern, right) for rule, (pattern, right) in in_lines.items() if wanted(rule)]
    whole = text_lines.withColumn("text", F.when(F.col("line") == 1, F.regexp_replace("text", r"^\uFEFF", "")).otherwise(F.col("text")))
    above = whole.select(*keys, F.inline(F.concat(*hidden))) if hidden else None
    # What paths and cheap searches tell is found once per text and per segment; the patterns run only where they can hit.
    paths = {"_prompt": F.col("path").rlike(p.PROMPT_ENDING), "_svg": F.col("path").rlike(p.SVG_ENDING), "_attributes": F.col("path").rlike(r"(?:^|/)\.gitattributes$")}
    segments = whole.withColumns(paths).select(*keys, *paths, F.explode(F.split("text", _SPLIT)).alias("seg")).where("seg <> ''")
    seg = F.col("seg")
    segments = segments.withColumns({"_short": F.length("seg") <= p.MAX_SEGMENT, "_risky": seg.rlike(p.RISKY_WORDS), "_digits": seg.rlike("[0-9]"), "_numbers": seg.rlike("[0-9]{3}")})
    digits, short, risky, numbers = (F.col(c) for c in ("_digits", "_short", "_risky", "_numbers"))
    sends = risky | seg.rlike("requests|urllib|fetch|axios")
    pairs = F.arrays_zip(_all(p.PHONE_INTERNATIONAL).alias("raw"), _all(p.PHONE_INTERNATIONAL, 2).alias("after"))
    phones = F.transform(F.filter(pairs, lambda x: is_phone(x["raw"], x["after"])), lambda x: F.regexp_replace(x["raw"], r"[ \-.(]+$", ""))
    cards = F.filter(F.transform(_all(p.CARD), _digits), lambda d: d.rlike(f"^(?:{p.CARD_BRANDS})$") & luhn(d))
    ibans = F.filter(F.transform(_all(p.IBAN), iban_value), lambda v: v.isNotNull())
    attributes = F.col("_attributes") & ~seg.rlike(r"^\s*#")
    tokens = F.split(F.trim(F.regexp_replace(seg, r"\s+", " ")), " ")
    hides = F.exists(F.slice(tokens, F.lit(2), F.size(tokens)), lambda a: a.isin("-diff", "binary", "-text") | a.startswith("diff="))
    on_segments = [
        ("phone-number", lambda: _some("phone-number", _when(digits & seg.rlike(r"\+\(?[0-9]"), phones))),
        ("phone-number", lambda: _some("phone-number", _when(numbers & seg.rlike(r"[0-9]{3}[-.][0-9]{4}"), _all(p.PHONE_NORTH_AMERICAN)))),
        ("us-ssn", lambda: _some("us-ssn", _when(numbers & seg.rlike("[0-9]{3}-[0-9]{2}-"), _all(p.SSN)))),
        ("us-ssn", lambda: _some("us-ssn", _when(numbers & seg.rlike("(?i)ssn|security"), _all(p.SSN_BY_NAME)))),
        ("credit-card", lambda: _some("credit-card", _when(numbers & seg.rlike("[0-9]{13}|[0-9]{4}[-\t ]+[0-9]{4}"), cards))),
        ("iban", lambda: _some("iban", _when(digits & seg.rlike("[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11}"), ibans))),
        ("private-key", lambda: _flag("private-key", seg.contains("-----BEGIN ") & seg.rlike(p.PRIVATE_KEY), "header present")),
        ("whatsapp-export", lambda: _flag("whatsapp-export", digits & seg.rlike("[0-9][/.-][0-9]{1,2}[/.-][0-9]") & _any(p.CHAT_LINES), "chat export line format")),
        ("long-line", lambda: _flag("long-line", ~short & risky, F.concat(F.length("seg").cast("string"), F.lit(" characters")))),
        *[(rule, lambda rule=rule, xs=xs: _flag(rule, short & risky & _any(xs), "pattern match")) for rule, xs in p.COMMANDS.items()],
        ("credential-exfil", lambda: _flag("credential-exfil", (seg.contains("/.") | seg.contains(".env")) & sends & seg.rlike("(?U)" + p.CREDENTIAL_PATH) & seg.rlike("(?U)" + p.NETWORK_SEND), "credential path + network send on one line")),
        ("email-address", lambda: _some("email-address", _when(seg.contains("@"), F.filter(_all(p.EMAIL), lambda a: ~email_is_open(a))))),
        ("prompt-injection", lambda: _flag("prompt-injection", F.col("_prompt") & _any(p.PROMPT_PHRASES), "phrase match")),
        ("svg-script", lambda: _flag("svg-script", F.col("_svg") & seg.rlike("(?U)" + p.SVG_SCRIPT), "script/handler")),
        ("git-lfs", lambda: _flag("git-lfs", attributes & seg.rlike(p.LFS_ATTRIBUTE), "filter=lfs attribute")),
        ("gitattributes-diff", lambda: _flag("gitattributes-diff", attributes & hides, "attribute hides or alters diffs")),
    ]
    built = [build() for rule, build in on_segments if wanted(rule)]
    below = segments.select(*keys, F.inline(F.concat(*built))) if built else None
    found = above.unionByName(below) if above is not None and below is not None else above if below is None else below
    if found is None:
        return text_lines.select(*keys, F.lit("").alias("rule"), F.lit("").alias("detail")).where("false")
    return found.distinct()


def _starts(magic: str) -> Column:
    return F.hex(F.substring("data", 1, len(magic) // 2)) == magic


def file_findings(entries: DataFrame) -> DataFrame:
    """Whole files: ``entry_id``, ``path``, ``data``, what was ``found`` on them, and ``stop`` where the text isn't to be read.

    The contents stay in their row, so that nothing is joined to find what is readable;
    where they aren't asked for, the optimizer doesn't carry them on.
    """
    ship(entries.sparkSession)
    head = F.decode(F.substring("data", 1, 1024), "ISO-8859-1")
    has_null = F.instr(head, "\x00") > 0
    is_file = F.col("kind") == "file"
    large = is_file & ((F.col("size") > p.MAX_FILE) | F.col("data").isNull())
    magic_exec = F.coalesce(*[F.when(_starts(m), k) for m, k in p.EXECUTABLE_MAGIC.items()], F.when(_starts("4D5A") & has_null, "PE (MZ)"))
    magic_arch = F.coalesce(*[F.when(_starts(m), k) for m, k in p.ARCHIVE_MAGIC.items()], F.when(_starts("425A68") & has_null, "bzip2"), F.when(F.hex(F.substring("data", 258, 5)) == "7573746172", "tar"))
    body = F.decode("data", "ISO-8859-1")
    embedded = F.coalesce(*[F.when(F.position(F.lit(bytes.fromhex(m).decode("latin-1")), body) > 1, F.concat(F.lit(f"embedded {k} at byte "), (F.position(F.lit(bytes.fromhex(m).decode("latin-1")), body) - 1).cast("string"))) for m, k in p.EMBEDDED_MAGIC.items()])
    x = entries.select("entry_id", "path", "kind", "size", "data", "escapes", "link_target")
    x = x.withColumns({"large": large, "e_end": is_file & F.col("path").rlike(p.EXECUTABLE_ENDING), "a_end": is_file & F.col("path").rlike(p.ARCHIVE_ENDING)})
    x = x.withColumns({"e_magic": F.when(is_file & ~F.col("large"), magic_exec), "a_magic": F.when(is_file & ~F.col("large") & magic_exec.isNull(), magic_arch)})
    image = F.when(is_file & ~F.col("large") & F.col("path").rlike(p.IMAGE_ENDING), image_status(F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)), F.col("data")))
    x = x.withColumn("image", image)
    escapes = F.coalesce("escapes", F.col("link_target").rlike(r"^/|^[A-Za-z]:[\\/]") | climbs_out(F.col("path"), F.coalesce("link_target", F.lit(""))))
    found = F.concat(
        _flag("submodule", F.col("kind") == "gitlink", "gitlink (mode 160000)"),
        _flag("symlink-escape", (F.col("kind") == "symlink") & escapes, "target outside repository"),
        _flag("executable-binary", F.col("e_end"), "extension"),
        _flag("archive-file", F.col("a_end"), "extension"),
        _flag("large-file", F.col("large"), F.concat(F.col("size").cast("string"), F.lit(" bytes"))),
        _flag("executable-binary", ~F.col("e_end") & F.col("e_magic").isNotNull(), F.col("e_magic")),
        _flag("archive-file", ~F.col("a_end") & F.col("a_magic").isNotNull(), F.col("a_magic")),
        _flag("archive-file", is_file & ~F.col("large") & F.col("a_magic").isNull() & embedded.isNotNull(), embedded),
        _flag("git-lfs", is_file & ~F.col("large") & F.startswith(head, F.lit(p.LFS_POINTER)), "LFS pointer file"),
        _flag("image-polyglot", F.col("image").startswith("polyglot:"), F.substring("image", 10, 1000)),
    )
    stop = ~is_file | F.col("large") | F.col("e_magic").isNotNull() | F.col("a_magic").isNotNull() | F.coalesce(F.col("image") != "mismatch", F.lit(False))
    return x.select("entry_id", "path", "data", found.alias("found"), F.coalesce(stop, F.lit(False)).alias("stop"))


def climbs_out(path: Column, target: Column) -> Column:
    """Whether a relative link target leaves the tree by more '..' than its folder is deep."""
    depth = F.size(F.split(path, "/")) - 1
    walk = F.aggregate(
        F.split(target, "/"),
        F.struct(depth.alias("d"), F.lit(False).alias("out")),
        lambda a, c: F.struct(F.when(c == "..", a["d"] - 1).when(c.isin("", "."), a["d"]).otherwise(a["d"] + 1).alias("d"), (a["out"] | (c == "..") & (a["d"] == 0)).alias("out")),
    )
    return walk["out"]


_WALK = "struct<at:array<string>,seen:array<struct<n:int,prefix:string>>,n:int,out:int>"


def escaping_links(links: DataFrame) -> DataFrame:
    """``repo``, ``path``, ``escapes`` of symbolic links (``repo``, ``path``, ``link_target``), following the links of the same repository.

    A link that leads outside, or in a circle, or through more than ``LINK_DEPTH`` links
    within one another, escapes. All links are followed at once, a link in the way each
    round: the folders on each one's way are joined with the links, and the way goes on
    from the first that is one. So no task holds the links of a repository. A null target
    leads nowhere; of repeated paths the greatest target counts.
    """
    scratch = Scratch(links.sparkSession, "links")
    one = links.where("path IS NOT NULL").groupBy("repo", "path").agg(F.max(F.coalesce("link_target", F.lit(""))).alias("target"))
    table = scratch.table(one, "links").df
    absolute = lambda t: t.rlike(r"^(?:/|.:[/\\])")
    items = lambda t, within: F.transform(F.filter(F.split(t, "/"), lambda c: ~c.isin("", ".")), lambda c: F.struct(c.alias("name"), within.alias("within")))
    folder = lambda path: F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    begun = table.select("repo", "path", folder(F.col("path")).alias("here"), items(F.col("target"), F.array("path")).alias("todo"), F.when(absolute(F.col("target")), True).alias("escapes"))
    walk = (
        f"aggregate(todo, CAST(struct(here, array(), 0, NULL) AS {_WALK}), (a, x) -> CAST(CASE WHEN a.out IS NOT NULL THEN a "
        f"WHEN x.name = '..' AND size(a.at) = 0 THEN CAST(struct(a.at, a.seen, a.n + 1, a.n) AS {_WALK}) WHEN x.name = '..' THEN CAST(struct(slice(a.at, 1, size(a.at) - 1), a.seen, a.n + 1, a.out) AS {_WALK}) "
        f"ELSE CAST(struct(concat(a.at, array(x.name)), concat(a.seen, array(named_struct('n', a.n, 'prefix', array_join(concat(a.at, array(x.name)), '/')))), a.n + 1, a.out) AS {_WALK}) END AS {_WALK}))"
    )
    done, state = [], begun
    while True:
        t = scratch.table(state, "walk").df
        done.append(t.where("escapes IS NOT NULL").select("repo", "path", "escapes"))
        going = t.where("escapes IS NULL")
        if going.isEmpty():
            break
        w = going.withColumn("w", F.expr(walk))
        met = w.select(F.col("repo").alias("r"), F.col("path").alias("p"), F.explode("w.seen").alias("s")).join(table.alias("l"), F.col("r").eqNullSafe(F.col("l.repo")) & (F.col("s.prefix") == F.col("l.path")))
        first = met.groupBy("r", "p").agg(F.min(F.struct("s.n", "s.prefix", "l.target")).alias("hit"))
        x = w.join(first, F.col("repo").eqNullSafe(F.col("r")) & (F.col("path") == F.col("p")), "left")
        within = F.col("todo")[F.col("hit.n")]["within"]
        ends = absolute(F.col("hit.target")) | F.array_contains(within, F.col("hit.prefix")) | (F.size(within) > p.LINK_DEPTH)
        rest = F.slice("todo", F.col("hit.n") + 2, F.size("todo"))
        state = x.select(
            "repo",
            "path",
            folder(F.col("hit.prefix")).alias("here"),
            F.concat(items(F.col("hit.target"), F.concat(within, F.array("hit.prefix"))), rest).alias("todo"),
            F.when(F.col("hit").isNull(), F.col("w.out").isNotNull()).when(ends, True).alias("escapes"),
        )
    return reduce(DataFrame.unionByName, done)


def findings(entries: DataFrame, rules: set[str] | None = None) -> DataFrame:
    """All findings of files, or those of ``rules``: ``entry_id``, ``path``, ``line`` (null for a whole file), ``rule``, ``detail``, ``severity``.

    Text rules are kept from files whose kind already says all: links, oversized,
    executable and archive files, and sound images.
    """
    files = file_findings(entries)
    return with_severity(_findings(files, lines(texts_of(files).drop("looks_binary")), rules))


def texts_of(files: DataFrame) -> DataFrame:
    """The decoded texts of those files whose text is to be read."""
    return decoded(files.where("NOT stop AND data IS NOT NULL").select("entry_id", "path", "data")).drop("data")


def _findings(files: DataFrame, text_lines: DataFrame, rules: set[str] | None = None) -> DataFrame:
    binary = _flag("binary-file", ~F.col("stop") & F.col("data").isNotNull() & (encoding(F.col("data")) == "binary"), "non-text content")
    whole = files.select("entry_id", "path", F.lit(None).cast("int").alias("line"), F.inline(F.concat("found", binary)))
    if rules is not None:
        whole = whole.where(F.col("rule").isin(sorted(rules)))
    return whole.unionByName(line_findings(text_lines, rules).select("entry_id", "path", "line", "rule", "detail"))


def marked_lines(files: DataFrame) -> DataFrame:
    """Lines of files with a comment that may override a finding; others aren't cut out of their text."""
    return lines(texts_of(files).where(F.col("text").contains("scan-allow:")).drop("looks_binary"))


def with_severity(found: DataFrame) -> DataFrame:
    severity = F.create_map(*[F.lit(x) for r, (s, _) in p.RULES.items() for x in (r, s)])
    return found.withColumn("severity", severity[F.col("rule")])


def glob_regex(glob: str) -> str:
    """A path pattern, in which '*' also spans '/', as a regular expression."""
    return fnmatch.translate(glob).replace(r"(?s:", "(?s:").removesuffix(r"\Z").removesuffix(r"\z") + "$"


def overridden(found: DataFrame, text_lines: DataFrame, allow: list[tuple[str, str]]) -> DataFrame:
    """``found`` with ``status``: skipped (path allowed), suppressed (comment beside the line), reported.

    ``allow``: rules and path patterns of a reviewed list, small and hand-written. A
    comment counts on its own line and for the next; only some rules heed it.
    """
    skipped = F.lit(False)
    for rule, glob in allow:
        if rule not in p.RULES:
            raise ValueError(f"unknown rule {rule!r}")
        skipped = skipped | (F.col("rule") == rule) & F.col("path").rlike("^" + glob_regex(glob))
    marks = text_lines.where(F.col("text").contains("scan-allow:")).select("entry_id", "line", F.explode(F.split(F.regexp_extract("text", p.INLINE_ALLOW, 1), r"\s*,\s*")).alias("rule"))
    marks = marks.select("entry_id", F.explode(F.array("line", F.col("line") + 1)).alias("line"), "rule").distinct().withColumn("mark", F.lit(True))
    heed = F.col("rule").isin([r for r, (_, inline) in p.RULES.items() if inline])
    x = found.join(marks, ["entry_id", "line", "rule"], "left")
    marked = F.coalesce("mark", F.lit(False))
    status = F.when(skipped, "skipped").when(marked & heed, "suppressed").otherwise("reported")
    note = F.when(marked & ~heed & ~skipped, F.concat(F.col("detail"), F.lit(" (a comment doesn't override this rule)"))).otherwise(F.col("detail"))
    return x.withColumn("status", status).withColumn("detail", note).drop("mark")


def totals(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "status").agg(F.count(F.lit(1)).alias("findings"))
