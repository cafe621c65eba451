"""Facts of the other languages: declarations by their heads and braces, imports, and calls by name.

A tier of expressions over masked text (comments and strings are blanked, so offsets stay), one table row a language.  It
does not know a language's grammar, so its files are always partial, and names that several things in scope could mean stay
ambiguous or unresolved.
"""

from __future__ import annotations

import re

_NAME = r"[A-Za-z_$][\w$]*"
_C = r'/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
_JS = _C + r"|`(?:\\.|[^`\\])*`"
_HASH = r'"(?:\\.|[^"\\])*"|\'[^\']*\'|(?<![$\w{])#[^\n]*'
#: language -> (what is masked, [(kind, expression with a group ``name``)], imports with a group ``path``, words that are no calls)
_WORDS = "if for while switch return catch sizeof typeof new match foreach function await super else do when elseif include require isset empty echo print list array exit die unset using lock fixed func fn impl source then fi done esac local export readonly declare shift set true false case in cd".split()
_NO_NAMES = {"if", "for", "while", "switch", "return", "catch", "else", "do", "sizeof", "foreach", "function", "await"}
_TYPES = r"(?:[\w:<>\[\],.*&?\s~]+?[\s*&])"
LANGUAGES: dict[str, tuple[str, list[tuple[str, str]], str]] = {
    "typescript": (_JS, [
        ("class", rf"\bclass\s+(?P<name>{_NAME})"), ("interface", rf"\binterface\s+(?P<name>{_NAME})"), ("enum", rf"\benum\s+(?P<name>{_NAME})"),
        ("namespace", rf"\bnamespace\s+(?P<name>{_NAME})"), ("type", rf"\btype\s+(?P<name>{_NAME})\s*(?:<[^=]*>)?\s*="), ("function", rf"\bfunction\s*\*?\s*(?P<name>{_NAME})\s*[<(]"),
        ("function", rf"\b(?:const|let|var)\s+(?P<name>{_NAME})\s*(?::[^=;]*)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=]*)?=>|{_NAME}\s*=>)"),
        ("variable", rf"\bexport\s+(?:const|let|var)\s+(?P<name>{_NAME})\b"),
        ("method", rf"^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?(?P<name>(?!(?:if|for|while|switch|catch|function|return)\b){_NAME})\s*(?:<[^<>]*>)?\([^()]*\)\s*(?::[^{{;=]*)?\{{")],
        r"""(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)(?P<path>["'][^"'\n]+["'])"""),
    "go": (_C + r"|`[^`]*`", [
        ("method", rf"^func\s*\(\s*(?:\w+\s+)?\*?(?P<owner>\w+)(?:\[[^\]]*\])?\s*\)\s*(?P<name>{_NAME})\s*[\[(]"), ("function", rf"^func\s+(?P<name>{_NAME})\s*[\[(]"),
        ("struct", rf"^type\s+(?P<name>{_NAME})(?:\[[^\]]*\])?\s+struct\b"), ("interface", rf"^type\s+(?P<name>{_NAME})(?:\[[^\]]*\])?\s+interface\b"), ("type", rf"^type\s+(?P<name>{_NAME})\s+(?!struct\b|interface\b)\S"),
        ("constant", rf"^const\s+(?P<name>{_NAME})\b"), ("variable", rf"^var\s+(?P<name>{_NAME})\b")],
        r'(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?(?P<path>"[\w./~-]+")\s*$'),
    "rust": (r'/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\])*"', [
        ("impl", rf"^\s*(?:unsafe\s+)?impl(?:\s*<[^{{]*?>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<name>{_NAME})"), ("struct", rf"\bstruct\s+(?P<name>{_NAME})"), ("enum", rf"\benum\s+(?P<name>{_NAME})"),
        ("union", rf"^\s*(?:pub\s+)?union\s+(?P<name>{_NAME})"), ("trait", rf"\btrait\s+(?P<name>{_NAME})"), ("type", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<name>{_NAME})"), ("macro", rf"\bmacro_rules!\s*(?P<name>{_NAME})"),
        ("function", rf"\bfn\s+(?P<name>{_NAME})"), ("constant", rf"\b(?:const|static)\s+(?:mut\s+)?(?P<name>{_NAME})\s*:"), ("module", rf"\bmod\s+(?P<name>{_NAME})")],
        r"(?m)^\s*(?:pub\s+)?use\s+(?P<path>[\w:]+)"),
    "java": (_C, [
        ("annotation", rf"@interface\s+(?P<name>{_NAME})"), ("class", rf"\bclass\s+(?P<name>{_NAME})"), ("interface", rf"(?<!@)\binterface\s+(?P<name>{_NAME})"), ("enum", rf"\benum\s+(?P<name>{_NAME})"),
        ("record", rf"\brecord\s+(?P<name>{_NAME})\s*[<(]"),
        ("method", rf"^[ \t]+(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|default|native)\s+)*(?:<[^<>]*>\s*)?(?!(?:return|new|else|throw)\b){_NAME}(?:<[^;(){{]*>)?(?:\[\])*\s+(?P<name>{_NAME})\s*\([^;{{]*\)\s*(?:throws[^{{;]*)?[{{;]"),
        ("constructor", rf"^[ \t]+(?:public|private|protected)\s+(?P<name>[A-Z]\w*)\s*\([^;{{]*\)\s*(?:throws[^{{;]*)?\{{")],
        r"(?m)^\s*import\s+(?:static\s+)?(?P<path>[\w.]+(?:\.\*)?)\s*;"),
    "csharp": (_C, [
        ("namespace", r"\bnamespace\s+(?P<name>[\w.]+)"), ("class", rf"\bclass\s+(?P<name>{_NAME})"), ("struct", rf"\bstruct\s+(?P<name>{_NAME})"), ("interface", rf"\binterface\s+(?P<name>{_NAME})"), ("enum", rf"\benum\s+(?P<name>{_NAME})"),
        ("record", rf"\brecord\s+(?:class\s+|struct\s+)?(?P<name>{_NAME})"), ("delegate", rf"\bdelegate\s+[\w<>\[\]?]+\s+(?P<name>{_NAME})\s*\("), ("event", rf"\bevent\s+[\w<>?]+\s+(?P<name>{_NAME})\s*[;{{]"),
        ("method", rf"^[ \t]+(?:(?:public|private|protected|internal|static|virtual|override|abstract|async|sealed|partial|extern)\s+)+[\w<>\[\],?.]+\s+(?P<name>{_NAME})\s*(?:<[^<>]*>)?\([^;{{]*\)\s*(?:where[^{{]*)?(?:\{{|=>|;)"),
        ("constructor", rf"^[ \t]+(?:public|private|protected|internal)\s+(?P<name>[A-Z]\w*)\s*\([^;{{]*\)\s*(?::[^{{]*)?\{{"),
        ("property", rf"^[ \t]+(?:(?:public|private|protected|internal|static|virtual|override|abstract|required)\s+)+[\w<>\[\],?.]+\s+(?P<name>{_NAME})\s*(?:\{{\s*(?:get|set|init)|=>)"),
        ("field", rf"^[ \t]+(?:(?:public|private|protected|internal|static|readonly|const)\s+)+[\w<>\[\],?.]+\s+(?P<name>{_NAME})\s*[=;]")],
        r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?(?P<path>[\w.]+)\s*;"),
    "c": (_C, [
        ("macro", rf"^[ \t]*#[ \t]*define[ \t]+(?P<name>{_NAME})"), ("struct", rf"\bstruct\s+(?P<name>{_NAME})\s*\{{"), ("union", rf"\bunion\s+(?P<name>{_NAME})\s*\{{"), ("enum", rf"\benum\s+(?P<name>{_NAME})\s*\{{"),
        ("type", rf"^typedef\b[^;{{}}]*?\b(?P<name>{_NAME})\s*;"), ("function", rf"^(?!typedef|return|else|#){_TYPES}\**(?P<name>{_NAME})\s*\([^;{{}}]*\)\s*[{{;]"), ("variable", rf"^(?:static\s+|extern\s+|const\s+)*[\w*]+\s+\**(?P<name>{_NAME})\s*(?:=[^;]*)?;")],
        r'(?m)^[ \t]*#[ \t]*include[ \t]*(?P<path>"[^"\n]+"|<[^>\n]+>)'),
    "php": (_C + r"|#(?!\[)[^\n]*", [
        ("class", rf"\bclass\s+(?P<name>{_NAME})"), ("interface", rf"\binterface\s+(?P<name>{_NAME})"), ("trait", rf"\btrait\s+(?P<name>{_NAME})"), ("enum", rf"\benum\s+(?P<name>{_NAME})"),
        ("function", rf"\bfunction\s+&?\s*(?P<name>{_NAME})\s*\("), ("constant", rf"\bconst\s+(?:\w+\s+)?(?P<name>{_NAME})\s*="), ("case", rf"^\s*case\s+(?P<name>{_NAME})\s*[=;]"),
        ("property", rf"\b(?:public|private|protected)\s+(?:static\s+|readonly\s+)*(?:\??[\w|\\]+\s+)?\$(?P<name>\w+)")],
        r"(?m)^\s*use\s+(?:function\s+|const\s+)?\\?(?P<path>[\w\\]+)|\b(?:require|include)(?:_once)?\s*\(?\s*(?:__DIR__\s*\.\s*)?(?P<path2>['\"][^'\"\n]+['\"])"),
    "bash": (_HASH, [
        ("function", r"^\s*(?:function\s+)?(?P<name>[\w:.-]+)\s*\(\s*\)"), ("function", r"^\s*function\s+(?P<name>[\w:.-]+)"), ("variable", r"^\s*(?:export\s+|readonly\s+|declare\s+(?:-\w+\s+)*|local\s+)?(?P<name>[A-Za-z_]\w*)=")],
        r"(?m)^\s*(?:source|\.)\s+(?P<path>[^\s;&|]+)"),
}
LANGUAGES["cpp"] = (_C, [("namespace", r"\bnamespace\s+(?P<name>[\w:]+)\s*\{"), ("class", rf"\bclass\s+(?P<name>{_NAME})[^;{{}}()]*\{{"), *LANGUAGES["c"][1][:5],
                         ("function", rf"^[ \t]*(?!typedef|return|else|using|#|delete|throw|new){_TYPES}?\**&?(?P<name>(?:\w+::)*~?{_NAME})\s*\([^;{{}}]*\)\s*(?:const|noexcept|override|final|\s)*(?::[^;{{]*)?\{{")], LANGUAGES["c"][2])
LANGUAGES["tsx"] = LANGUAGES["javascript"] = LANGUAGES["typescript"]
LANGUAGES["sh"] = LANGUAGES["bash"]
_COMPILED = {k: (re.compile(m, re.S), [(kind, re.compile(x, re.M)) for kind, x in d], re.compile(i)) for k, (m, d, i) in LANGUAGES.items()}
_CALL = re.compile(rf"(?P<name>{_NAME}(?:(?:\.|::|->)~?{_NAME})*)!?\s*(?:<[\w, .:<>]*>)?\(")
_COMMAND = re.compile(r"(?m)(?:^|[;&|({]|\bthen\b|\bdo\b|\belse\b|\$\()[ \t]*(?P<name>[A-Za-z_][\w:.-]*)(?=[\s;&|)]|$)")
_BASE = re.compile(rf"(?:\bextends\s+|\bimplements\s+|(?<!:):(?!:)\s*(?:public\s+|private\s+|protected\s+|virtual\s+)*)(?P<names>{_NAME}(?:[.\\]{_NAME})*(?:\s*,\s*{_NAME})*)")
_CONTAINERS = {"class", "interface", "enum", "struct", "union", "trait", "impl", "namespace", "record", "module", "annotation"}
_TEST_FILE = re.compile(r"(_test\.go|\.(?:test|spec)\.[cm]?[jt]sx?|(?:Test|Tests|IT)\.(?:java|cs|php)|\.bats)$")


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def _close(text: str, at: int) -> int:
    """Where the brace opened at ``at`` ends."""
    deep = 0
    for m in re.finditer(r"[{}]", text[at:]):
        deep += 1 if m[0] == "{" else -1
        if not deep:
            return at + m.end()
    return len(text)


def parse(path: str, data: bytes, dialect: str) -> dict:
    none = {"symbols": [], "uses": [], "exports": [], "coverage": "unsupported", "diagnostics": []}
    try:
        data.decode()
    except UnicodeDecodeError as e:
        return none | {"diagnostics": [f"not UTF-8: {e.reason} at byte {e.start}"]}
    text = data.decode("latin-1")  # one character a byte: offsets are bytes
    masked, heads, imports = _COMPILED[dialect]
    bare = masked.sub(_blank, text)
    found: dict[int, tuple[int, int, str, str, str | None]] = {}
    for kind, expression in heads:
        for m in expression.finditer(bare):
            if m["name"] in _NO_NAMES or m.start("name") in found:
                continue
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            stop = bare.find(";", m.end() - 1) if m[0].endswith(";") else -1
            brace = bare.find("{", m.start("name"))
            semi = bare.find(";", m.start("name"))
            newline = bare.find("\n", m.end())
            if stop >= 0 or brace < 0 or 0 <= semi < brace or kind in ("macro", "constant", "variable", "case", "field", "type") or dialect in ("bash", "sh") and 0 <= newline < brace and bare[m.end() : brace].strip():
                end = min([x + 1 for x in (semi, newline) if x >= 0] or [len(bare)]) if kind in ("macro", "variable") else semi + 1 if semi >= 0 else len(bare)
                head = end
            else:
                head, end = brace, _close(bare, brace)
            line = bare.rfind("\n", 0, start) + 1
            start = line + len(text[line:start]) - len(text[line:start].lstrip()) if not bare[line:start].strip(" \tabcdefghijklmnopqrstuvwxyz()@") else start
            found[m.start("name")] = (start, end, kind, m["name"], text[start:head].strip().rstrip("{;=").strip())
            if "owner" in (m.groupdict() or {}) and m["owner"]:
                found[m.start("name")] = (*found[m.start("name")][:3], f"{m['owner']}.{m['name']}", found[m.start("name")][4])
    rows = sorted(found.values(), key=lambda x: (x[0], -x[1]))
    symbols, stack, names, is_test = [], [], {}, bool(_TEST_FILE.search(path))
    spans = []
    for start, end, kind, name, signature in rows:
        while stack and stack[-1][1] <= start:
            stack.pop()
        if stack and stack[-1][2] not in _CONTAINERS and kind in ("variable", "constant", "method", "constructor", "field", "property"):
            continue
        outer = stack[-1] if stack else None
        kind = "method" if kind == "function" and outer and outer[2] in _CONTAINERS - {"namespace", "module"} else kind
        base = outer[3] + "." if outer else f"symbol:{path}#"
        shown = name.replace("::", ".").replace("\\", ".")
        n = names.get(base + shown, 0)
        names[base + shown] = n + 1
        key = base + shown + (f"~{n}" if n else "")
        head = text[max(0, start - 200) : start + 200]
        test = is_test and (kind in ("function", "method") and bool(re.match(r"(?i)test|it\b|describe\b|benchmark", name.rsplit(".", 1)[-1]) or re.search(r"@Test|\[(?:Fact|Theory|Test)", head))) or dialect == "rust" and bool(re.search(r"#\[(?:tokio::)?test\]\s*(?:async\s+)?(?:pub\s+)?$", text[max(0, start - 60) : start]))
        symbols.append((key, outer[3] if outer else f"file:{path}", kind, name.rsplit(".", 1)[-1].rsplit("::", 1)[-1], signature.encode("latin-1").decode("utf-8", "replace")[:512], start, end, test))
        spans.append((start, end, key))
        stack.append((start, end, kind, key))
    members: dict[tuple[str, str], list[str]] = {}
    parent = {}
    for key, outer, _, name, *_ in symbols:
        members.setdefault((outer, name), []).append(key)
        parent[key] = outer
    starts = [s for s, _, _ in spans]
    import bisect

    def owner(at: int) -> str:
        for i in range(bisect.bisect_right(starts, at) - 1, -1, -1):
            if spans[i][0] <= at < spans[i][1]:
                return spans[i][2]
        return f"file:{path}"

    uses = []
    for m in imports.finditer(masked.sub(lambda x: x[0] if x[0][:1] in "\"'`" else _blank(x), text)):
        name = next(x for x in (m.groupdict() or {}).values() if x).strip("\"'<>")
        uses.append(("imports", f"file:{path}", name, [], name, False, m.start(), m.end()))
    heads_at = set(found)
    for m in (_COMMAND if dialect in ("bash", "sh") else _CALL).finditer(bare):
        name = m["name"]
        if name in _WORDS or m.start("name") in heads_at or any(m.start("name") <= h < m.end("name") for h in (m.end("name") - len(name.rsplit(".", 1)[-1]),) if h in heads_at):
            continue
        source = owner(m.start("name"))
        parts = re.split(r"\.|::|->|\\", name)
        keys: list[str] = []
        guess = False
        if parts[0] in ("this", "self", "Self", "$this") and len(parts) == 2:
            at = parent.get(source, "")
            keys, guess = members.get((at, parts[1]), []), True
        else:
            at = source
            while not keys:
                keys = members.get((at, parts[0]), [])
                if at.startswith("file:"):
                    break
                at = parent.get(at, f"file:{path}")
            for p in parts[1:]:
                keys = [k for x in keys for k in members.get((x, p), [])]
        uses.append(("calls", source, name, sorted(keys), None if keys else name, guess and bool(keys), m.start("name"), m.end("name")))
    for start, end, key in spans:
        head = bare[start : bare.find("{", start) if 0 <= bare.find("{", start) < end else end]
        if re.match(r"[\w\s@]*?\b(class|interface|struct|trait|enum|record)\b", head):
            for m in _BASE.finditer(head):
                for name in re.split(r"\s*,\s*", m["names"]):
                    keys = members.get((f"file:{path}", name), [])
                    at = text.find(name, start + m.start("names"))
                    uses.append(("references", key, name, sorted(keys), None if keys else name, False, at, at + len(name)))
    return {"symbols": symbols, "uses": sorted(uses, key=lambda u: (u[6], u[7], u[0])), "exports": [], "coverage": "partial", "diagnostics": ["read by expressions, not by a grammar"]}
