"""Layered path rules: globs, verdicts, pruning below directories that are out, and foreign rule files."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules for what regenerates, what is confidential, and names exempted from the latter.
DEFAULT_IGNORE = """
node_modules
.next
.turbo
dist
out
bin
obj
target
.venv
__pycache__
coverage
TestResults
Pods
Library/
Temp/
Logs/
UserSettings/
.stfolder
.stversions
*.sync-conflict-*
.DS_Store
Thumbs.db
desktop.ini
*.swp
*~
.idea
**/.vscode/chrome-debug-profile
*.tgz.tmp
*.tmp
""".split()
DEFAULT_NEVER = """
*.pem
*.key
*.p12
*.pfx
*.jks
*.keystore
*.cer
*.crt
*.der
id_rsa
id_dsa
id_ecdsa
id_ed25519
*.certSigningRequest
.env
.env.*
=.env.example
=.env.sample
=.env.template
**/.aws/credentials
.npmrc
.pypirc
service-account*.json
*.secret
secrets.*
""".split()
# What marks a pattern, and what marks a section's comment, as confidential in a foreign file.
PATTERN_HINTS = """
secret credential password passwd token apikey api_key key cert pem pfx .p12 keystore private
.env .cer audit rgpd gdpr id_rsa id_ed25519
""".split()
SECTION_HINTS = """
sensitive sensible secret confidential confidentiel private prive privé never jamais
credential identifiant rgpd gdpr audit cryptograph certificat certificate
""".split()


class Rule(NamedTuple):
    """A compiled glob: an anchored regex, whether it matches directories alone, whether it re-includes."""

    regex: str
    dir_only: bool
    negated: bool


class Policy(NamedTuple):
    ignore: tuple[Rule, ...]
    never: tuple[Rule, ...]
    exempt: tuple[str, ...]


def _segment(text: str) -> str:
    """A path component's glob as a regex; a bracket without an end is a character."""
    out, k = "", 0
    while k < len(text):
        c, end = text[k], -1
        if c == "[":
            end = text.find("]", k + 1)
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif end > 0:
            body = text[k + 1 : end]
            inverted = body[:1] in ("!", "^")
            body = re.sub(r"([\\\[\]^&~|])", r"\\\1", body[inverted:])
            out += ("[^/" + body + "]" if inverted else "(?!/)[" + body + "]" if body else "[^\\s\\S]").replace("(?!/)", "")
            k = end
        else:
            out += "\\" + c if c in r"\.[]{}()+-^$|" else c
        k += 1
    return out


def compile_glob(pattern: str, negated: bool = False) -> Rule | None:
    """The rule of a pattern; None for an empty one.

    A pattern without a slash holds at any depth; a final slash means directories alone. ** stands for any
    number of components, at the end for none.
    """
    text = pattern.strip()
    dir_only = text.endswith("/")
    text = text.rstrip("/") if dir_only else text
    if not text:
        return None
    parts = [p for p in text.split("/") if p]
    if "/" not in text:
        parts = ["**", *parts]
    regex = ""
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            if last:
                regex = regex.removesuffix("/")
            elif not regex.endswith("(?:[^/]*/)*"):
                regex += "(?:[^/]*/)*"
        else:
            regex += _segment(part) + ("" if last else "/")
    return Rule(f"^(?:{regex})$", dir_only, negated)


def parse_policy(ignore: list[str], never: list[str]) -> Policy:
    """Raises ValueError for a negation among never rules and for an exemption with wildcards."""
    rules: dict[str, list[Rule]] = {"ignore": [], "never": []}
    exempt = []
    for kind, lines in (("ignore", ignore), ("never", never)):
        for line in map(str.strip, lines):
            if not line or line.startswith("#"):
                continue
            if kind == "never" and line.startswith("!"):
                raise ValueError(f"a never rule cannot be negated: {line}")
            if kind == "never" and line.startswith("="):
                if set(line) & set("*?[]"):
                    raise ValueError(f"an exemption is one literal name: {line}")
                exempt.append(line[1:].strip())
                continue
            negated = line.startswith("!")
            if rule := compile_glob(line[negated:], negated):
                rules[kind].append(rule)
    return Policy(tuple(rules["ignore"]), tuple(rules["never"]), tuple(exempt))


def load_policy(ignore_text: str | None, never_text: str | None) -> Policy:
    """A missing ignore text means the default rules; a missing never text too, never none."""
    return parse_policy(DEFAULT_IGNORE if ignore_text is None else ignore_text.split("\n"), DEFAULT_NEVER if never_text is None else never_text.split("\n"))


def matches(rule: Rule, path: Column, is_dir: Column) -> Column:
    hit = path.rlike(rule.regex)
    return hit & is_dir if rule.dir_only else hit


def verdict(policy: Policy, path: Column | str, is_dir: Column | bool) -> Column:
    """Include, Ignored or Never. Exempt names lift never rules alone; of ignore rules the last match decides. One CASE, later rules first."""
    path = F.col(path) if isinstance(path, str) else path
    is_dir = F.lit(is_dir) if isinstance(is_dir, bool) else is_dir
    out = None

    def when(condition: Column, value: str) -> None:
        nonlocal out
        out = F.when(condition, value) if out is None else out.when(condition, value)

    names = F.element_at(F.split(path, "/"), -1)
    exempt = path.isin(*policy.exempt) | names.isin(*policy.exempt) if policy.exempt else F.lit(False)
    if policy.never:
        any_never = matches(policy.never[0], path, is_dir)
        for rule in policy.never[1:]:
            any_never = any_never | matches(rule, path, is_dir)
        when(~exempt & any_never, "Never")
    for rule in reversed(policy.ignore):
        when(matches(rule, path, is_dir), "Include" if rule.negated else "Ignored")
    return F.lit("Include") if out is None else out.otherwise("Include")


def judge(policy: Policy, path: str, is_dir: bool) -> str:
    """The verdict on one path, outside Spark: for a lister that doesn't enter what is out."""
    def hit(rule: Rule) -> bool:
        return (is_dir or not rule.dir_only) and re.search(rule.regex, path) is not None

    if not {path, path.rsplit("/", 1)[-1]} & set(policy.exempt) and any(map(hit, policy.never)):
        return "Never"
    last = next((rule for rule in reversed(policy.ignore) if hit(rule)), None)
    return "Include" if last is None or last.negated else "Ignored"


def with_ancestors(paths: DataFrame, path: str = "path") -> DataFrame:
    """paths with at (each directory above, then the path itself), depth, is_dir."""
    parts = F.split(path, "/")
    depth = F.explode(F.sequence(F.lit(1), F.size(parts)))
    return paths.withColumn("depth", depth).withColumns({"at": F.array_join(F.slice(parts, 1, F.col("depth")), "/"), "is_dir": F.col("depth") < F.size(parts)})


def topmost(policy: Policy, path: Column | str) -> Column:
    """struct(at, verdict, is_dir) of the highest directory that is out, or the path itself if it is; null for what is kept.

    Works on each row alone: the components are walked inside one expression, nothing is exploded or shuffled.
    """
    path = F.col(path) if isinstance(path, str) else path
    parts = F.split(path, "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda d: F.struct(F.array_join(F.slice(parts, F.lit(1), d), "/").alias("at"), (d < F.size(parts)).alias("is_dir")))
    judged = F.transform(every, lambda x: F.struct(x["at"].alias("at"), verdict(policy, x["at"], x["is_dir"]).alias("verdict"), x["is_dir"].alias("is_dir")))
    return F.get(F.filter(judged, lambda x: x["verdict"] != "Include"), F.lit(0))


def kept(files: DataFrame, policy: Policy, path: str = "path") -> DataFrame:
    """The files that no rule takes out, at any of their directories; a re-include below a directory that is out has no effect."""
    return files.where(topmost(policy, path).isNull())


def refused(files: DataFrame, policy: Policy, path: str = "path") -> DataFrame:
    """What is refused as confidential: each file, or its highest directory that is out once, with a final slash."""
    top = files.select(topmost(policy, path).alias("t")).where("t.verdict = 'Never'")
    return top.select(F.when(F.col("t.is_dir"), F.concat("t.at", F.lit("/"))).otherwise(F.col("t.at")).alias("refused")).distinct()


def outside_checkouts(files: DataFrame, path: str = "path") -> DataFrame:
    """The files that lie in no checkout: a directory with a .git entry, file or directory, takes all below it."""
    marks = F.filter(F.sequence(F.lit(1), F.size(F.split(path, "/"))), lambda d: F.get(F.split(path, "/"), d - 1) == ".git")
    roots = files.where(F.size(marks) > 0).select(F.array_join(F.slice(F.split(path, "/"), F.lit(1), F.get(marks, F.lit(0)) - 1), "/").alias("root")).distinct()
    above = with_ancestors(files.select(path), path).select(F.col(path), F.when(F.col("depth") == 1, F.array(F.lit(""), "at")).otherwise(F.array("at")).alias("ats")).select(path, F.explode("ats").alias("root"))
    inside = above.join(roots, "root", "left_semi").select(path).distinct()
    return files.join(inside, path, "left_anti")


class Imported(NamedTuple):
    ignore: list[str]
    never: list[str]
    unsupported: list[str]


def import_foreign(text: str) -> Imported:
    """The rules of another synchroniser's ignore file.

    A pattern goes to never if it names something confidential or stands in a section, up to the next blank
    line, whose comment does; a negated one never goes there. Flags in front are dropped and reported.
    """
    out = Imported([], [], [])
    confidential = False
    for raw in text.split("\n"):
        line = raw.strip()
        if not line:
            confidential = False
        elif line.startswith("//"):
            comment = line[2:].strip()
            confidential |= any(h in comment.lower() for h in SECTION_HINTS)
            out.ignore.append("# " + comment)
        elif line.lower().startswith("#include"):
            out.unsupported.append(line)
        else:
            pattern = re.sub(r"^(?:\(\?[^)]*\)\s*)+", "", line)
            if not pattern:
                continue
            secret = not pattern.startswith("!") and (confidential or any(h in pattern.lower() for h in PATTERN_HINTS))
            (out.never if secret else out.ignore).append(pattern)
            if pattern != line:
                out.unsupported.append(f"{line}  (flags dropped)")
    return out
