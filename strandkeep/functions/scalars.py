"""Scalar functions as Spark expressions: ids, names, sizes, ages, versions, URLs, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandkeep import settings

# An id's form, suffixes of companion files, temporary places, asset systems and machines.
ID_PATTERN = "^[0-9a-fA-F]{64}$"
COMPANIONS = ("theirs", "base", "tmp")
TEMPORARY = ("/tmp/", "/var/tmp/", "/var/folders/", "/private/tmp/", "/private/var/folders/")
SYSTEMS = ("macos", "linux", "windows")
MACHINES = {"x64": "x64", "x86_64": "x64", "amd64": "x64", "arm64": "arm64", "aarch64": "arm64"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def content_id(content: Column | str) -> Column:
    """SHA-256 in lower hex."""
    return F.sha2(_c(content), 256)


def is_id(text: Column | str) -> Column:
    return F.coalesce(_c(text).rlike(ID_PATTERN), F.lit(False))


def shard_of(id_: Column | str) -> Column:
    """The folder of an object: the first two digits of its id."""
    return F.substring(_c(id_), 1, 2)


def token_hash(token: Column | str) -> Column:
    return F.sha2(F.concat(F.lit(f"{settings.NAMESPACE}/token/v1/"), _c(token)), 256)


def ordinal(text: Column | str) -> Column:
    """A sort key by UTF-16 code units; plain order is by UTF-8 bytes and differs beyond U+D7FF."""
    return F.encode(_c(text), "UTF-16BE")


def fold_ascii(text: Column | str) -> Column:
    """ASCII letters in lower case, one to one; nothing else is touched."""
    return F.translate(_c(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def top_directory(path: Column | str) -> Column:
    """The first component, "(root)" for a path without a slash."""
    return F.when(F.contains(_c(path), F.lit("/")), F.substring_index(_c(path), "/", 1)).otherwise("(root)")


def escape_field(text: Column | str) -> Column:
    """Backslash, tab and newline escaped, as in the manifest text."""
    return F.replace(F.replace(F.replace(_c(text), F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))


def unescape_field(text: Column | str) -> Column:
    """The reverse; an unknown escape is kept as it is."""
    held = F.replace(_c(text), F.lit("\\\\"), F.lit("\x00"))
    return F.replace(F.replace(F.replace(held, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit("\x00"), F.lit("\\"))


def format_bytes(n: Column | str) -> Column:
    n = _c(n)
    return (
        F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1 << 20, F.concat(F.format_string("%.1f", n / 1024.0), F.lit(" KB")))
        .when(n < 1 << 30, F.concat(F.format_string("%.1f", n / 1024.0 / 1024), F.lit(" MB")))
        .otherwise(F.concat(F.format_string("%.2f", n / 1024.0 / 1024 / 1024), F.lit(" GB")))
    )


def ago(then: Column | str, now: Column) -> Column:
    """How long ago: just now under 90 seconds, minutes under 90, hours under 36, then days."""
    s = (F.unix_millis(now) - F.unix_millis(_c(then).cast("timestamp"))) / 1000.0
    return (
        F.when(s < 90, "just now")
        .when(s < 90 * 60, F.concat(F.format_string("%.0f", s / 60), F.lit(" min ago")))
        .when(s < 36 * 3600, F.concat(F.format_string("%.0f", s / 3600), F.lit(" h ago")))
        .otherwise(F.concat(F.format_string("%.0f", s / 86400), F.lit(" d ago")))
    )


def stamp(at: Column | str) -> Column:
    return F.date_format(_c(at).cast("timestamp"), "yyyyMMdd'T'HHmmss'Z'")


def version_parts(text: Column | str) -> Column:
    """array<int> of a version, null if it is none: an initial v goes, a suffix after + or - goes, two to four numbers stay."""
    bare = F.regexp_replace(F.trim(_c(text)), "^[vV]", "")
    bare = F.regexp_extract(bare, r"^([^+-]*)", 1)
    return F.when(bare.rlike(r"^\d{1,9}(\.\d{1,9}){1,3}$"), F.transform(F.split(bare, r"\."), lambda x: x.cast("int")))


def _padded(version: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.coalesce(F.get(version, k - 1), F.lit(-1)))


def update_verdict(current: Column | str, latest: Column | str) -> Column:
    """Available, UpToDate, Ahead, or Unknown if either is no version."""
    a, b = version_parts(current), version_parts(latest)
    return F.when(a.isNull() | b.isNull(), "Unknown").when(_padded(b) > _padded(a), "Available").when(_padded(b) == _padded(a), "UpToDate").otherwise("Ahead")


def write_allowed(client: Column | str, floor: str) -> Column:
    """Whether a client's version may write: not if it is under the floor or no version."""
    a, b = version_parts(client), version_parts(F.lit(floor))
    return F.coalesce(_padded(a) >= _padded(b), F.lit(False)) & a.isNotNull()


def checksum_for(sums: Column | str, name: Column | str) -> Column:
    """The digest of a name in a checksum file, null if it isn't listed; names compare whole."""
    lines = F.transform(F.split(_c(sums), "\n"), lambda x: F.filter(F.split(x, r"\s+"), lambda y: y != ""))
    listed = F.filter(lines, lambda x: (F.size(x) >= 2) & (F.length(x[0]) == 64) & (F.regexp_replace(F.element_at(x, -1), r"^\*+", "") == _c(name)))
    return F.lower(F.get(F.get(listed, F.lit(0)), F.lit(0)))


def asset_name(system: Column | str, machine: Column | str) -> Column:
    """The release file for a system and machine, null for unknown ones."""
    arch = F.create_map(*[F.lit(x) for kv in MACHINES.items() for x in kv])[_c(machine)]
    end = F.when(_c(system) == "windows", ".exe").otherwise("")
    return F.when(_c(system).isin(*SYSTEMS) & arch.isNotNull(), F.concat(F.lit(f"{settings.NAMESPACE}-"), _c(system), F.lit("-"), arch, end))


def is_temporary(path: Column | str, local: str | None = None) -> Column:
    """Whether a path lies where the system cleans up; local: this machine's own folder for that."""
    places = [*TEMPORARY, *([local.rstrip("/") + "/"] if local and len(local) > 1 else [])]
    return _any([F.startswith(_c(path), F.lit(x)) for x in places])


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for x in conditions[1:]:
        out = out | x
    return out


def relative_path(path: Column | str, root: str) -> Column:
    """The path below root, null outside it, "." for root itself."""
    root = root.rstrip("/")
    return F.when(_c(path) == root, ".").when(F.startswith(_c(path), F.lit(root + "/")), F.substring(_c(path), len(root) + 2, 1 << 30))


def is_safe_path(path: Column | str) -> Column:
    """Whether a relative path stays below its root: not absolute, and no prefix of it climbs above."""
    parts = F.filter(F.split(_c(path), "/"), lambda x: (x != "") & (x != "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, x: F.struct(
        (a["at"] + F.when(x == "..", -1).otherwise(1)).alias("at"),
        F.least(a["low"], a["at"] + F.when(x == "..", -1).otherwise(1)).alias("low"),
    ))
    return ~F.startswith(_c(path), F.lit("/")) & (depth["low"] >= 0) & (F.size(parts) > 0)


def is_companion(path: Column | str) -> Column:
    """Whether any component of a path ends in a companion suffix, or the first is the engine's own folder."""
    name = settings.NAMESPACE
    ends = F.exists(F.split(_c(path), "/"), lambda x: _any([F.endswith(x, F.lit(f".{name}-{s}")) for s in COMPANIONS]))
    return ends | (F.substring_index(_c(path), "/", 1) == f".{name}")


def looks_binary(content: Column | str) -> Column:
    """A NUL in the first 8000 bytes."""
    return F.contains(F.substring(_c(content).cast("binary"), 1, 8000), F.unhex(F.lit("00")))


def url_parts(raw: Column | str) -> tuple[Column, Column, Column, Column]:
    """(text, scheme, user, host) of a URL; https is assumed where no scheme is given."""
    text = F.regexp_replace(F.coalesce(_c(raw), F.lit("")), r"^\s+|\s+$", "")
    text = F.when(F.contains(text, F.lit("://")) | (text == ""), text).otherwise(F.concat(F.lit("https://"), text))
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:@]+)"
    return text, F.lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2), F.lower(F.regexp_extract(text, pattern, 3))


def url_verdict(raw: Column | str, allow_insecure: bool = False) -> Column:
    """ok, warn (plain HTTP allowed), or why a URL is refused: empty, invalid, scheme, credentials, insecure. Loopback may be plain."""
    text, scheme, user, host = url_parts(raw)
    local = (host == "localhost") | host.rlike(r"^127\.\d+\.\d+\.\d+$") | (host == "[::1]")
    return (
        F.when(text == "", "empty").when(scheme == "", "invalid").when(~scheme.isin("http", "https"), "scheme")
        .when(user != "", "credentials").when((scheme == "https") | local, "ok")
        .otherwise("warn" if allow_insecure else "insecure")
    )


def url_normal(raw: Column | str) -> Column:
    """The URL without query, fragment and final slashes."""
    return F.regexp_replace(F.regexp_extract(url_parts(raw)[0], r"^([^?#]*)", 1), "/+$", "")


def saved_url_warning(raw: Column | str) -> Column:
    """Whether a saved URL sends over plain HTTP to another machine."""
    return url_verdict(raw, allow_insecure=True) == "warn"
