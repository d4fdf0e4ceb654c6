"""Definitions, calls and imports of languages other than Python, by lexical scanning.

A source is first blanked: comments and the insides of strings become spaces of
the same length, so that positions stay.  Definitions are found by one pattern
a language, their extents by brackets or by ``end``.  A definition's parent is
the innermost class-like definition around it; its calls are those outside
definitions nested in it.  All work is linear in the source, apart from the
number of definitions nested in one another.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field

CLASS_LIKE = ("Class", "Interface", "Type")

# What is blanked, by family of languages.
LINE, BLOCK, HASH = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)", r"(?:(?<=\s)|\A)#[^\n]*"
DOUBLE, SINGLE, BACK, TRIPLE = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'", r"`(?:\\.|[^`\\])*`", r'""".*?(?:"""|\Z)'
CHARACTER = r"'(?:\\[^\n']+|[^'\\\n])'"
#: Words before a bracket that make no call.
NO_CALL = frozenset(
    "if for while switch catch return function func fn def fun sizeof typeof await match when until unless elsif elseif foreach using lock and or not in is as new throw case do else super constructor init assert yield defer go select guard where synchronized try with".split()
)


@dataclass
class Language:
    """``definitions`` are (pattern with a group ``name``, label); ``opens`` and ``closes`` are words where blocks end with one."""

    blanked: tuple[str, ...]
    definitions: tuple[tuple[str, str], ...]
    imports: Callable[[str], list[tuple[int, str, list[str], str]]] = lambda source: []
    opens: str = ""
    closes: str = ""
    newline_ends: bool = False
    bare_calls: bool = False
    plain_calls: bool = False
    modifiers: bool = False
    pattern: re.Pattern = field(init=False)

    def __post_init__(self) -> None:
        self.pattern = re.compile("|".join(f"(?P<d{k}>{p.replace('?P<name>', f'?P<n{k}>')})" for k, (p, _) in enumerate(self.definitions)), re.M)


def at_start(words: str) -> str:
    """A pattern where a statement or member may start."""
    return r"(?:^|(?<=[;{}\n]))[ \t]*" + words


def found(pattern: str, build: Callable[[re.Match], list[tuple[str, list[str], str]]]) -> Callable[[str], list[tuple[int, str, list[str], str]]]:
    compiled = re.compile(pattern, re.M)

    def run(source: str) -> list[tuple[int, str, list[str], str]]:
        return [(m.start(), *one) for m in compiled.finditer(source) for one in build(m)]

    return run


def last_part(path: str, alias: str = "", separator: str = ".") -> tuple[str, list[str], str]:
    """The module and the one name of ``a.b.C``; a wildcard has no names."""
    module, _, name = path.rpartition(separator)
    return (module, [], alias) if name in ("*", "_") else (module, [name], alias) if module else (path, [], alias)


def selected(text: str, separator: str) -> list[tuple[str, str]]:
    """(name, alias) of ``a, b as c``."""
    parts = [re.split(separator, p.strip(), maxsplit=1) for p in text.split(",") if p.strip()]
    return [(p[0].strip(), p[1].strip() if len(p) > 1 else "") for p in parts]


def grouped(module: str, items: list[tuple[str, str]]) -> list[tuple[str, list[str], str]]:
    """One import for all plain names, and one for each name with an alias."""
    plain = [name for name, alias in items if not alias]
    return ([(module, plain, "")] if plain else []) + [(module, [name], alias) for name, alias in items if alias]


def script_import(m: re.Match) -> list[tuple[str, list[str], str]]:
    module, clause = m["from"] or m["bare"], (m["clause"] or "").strip().removeprefix("type ")
    out: list[tuple[str, list[str], str]] = []
    names = re.search(r"\{([^}]*)\}", clause)
    whole = re.search(r"\*\s+as\s+([\w$]+)", clause)
    default = re.match(r"([\w$]+)\s*(?:,|$)", clause)
    if default:
        out.append((module, ["default"], default[1]))
    if whole:
        out.append((module, [], whole[1]))
    if names:
        out += grouped(module, [(n.removeprefix("type ").strip(), a) for n, a in selected(names[1], r"\s+as\s+")])
    return out or [(module, [], "")]


def go_import(m: re.Match) -> list[tuple[str, list[str], str]]:
    lines = [m["one"]] if m["one"] else m["many"].split("\n")
    out = []
    for line in lines:
        hit = re.match(r'\s*(?:([\w.]+)\s+)?"([^"]+)"', line)
        if hit:
            alias = hit[1] or ""
            out.append((hit[2], [] if alias in ("_", ".") else [hit[2].rpartition("/")[2]], "" if alias in ("_", ".") else alias))
    return out


def rust_paths(text: str, prefix: str = "") -> list[tuple[str, str]]:
    """(path, alias) of each leaf of a tree of paths."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(text + ","):
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            part = text[start:k].strip()
            start = k + 1
            if not part:
                continue
            if part.endswith("}"):
                head, _, inner = part.partition("{")
                out += rust_paths(inner[:-1], prefix + head.strip())
            else:
                path, _, alias = part.partition(" as ")
                out.append((prefix + path.strip(), alias.strip()))
    return out


def rust_import(m: re.Match) -> list[tuple[str, list[str], str]]:
    return [(path.removesuffix("::self"), [], alias) if path.endswith("::self") else last_part(path, alias, "::") for path, alias in rust_paths(" ".join(m[1].split()))]


def scala_import(m: re.Match) -> list[tuple[str, list[str], str]]:
    if m["group"] is None:
        return [last_part(m["path"].rstrip("."))]
    items = [(n, a) for n, a in selected(m["group"], r"\s*=>\s*|\s+as\s+") if a != "_"]
    module = m["path"].rstrip(".")
    return ([(module, [], "")] if any(n in ("_", "*") for n, _ in items) else []) + grouped(module, [x for x in items if x[0] not in ("_", "*")])


def sharp_import(m: re.Match) -> list[tuple[str, list[str], str]]:
    return [last_part(m["path"], m["alias"] or "")] if m["alias"] or m["static"] else [(m["path"], [], "")]


C_BLANKED = (LINE, BLOCK, DOUBLE, CHARACTER)
SCRIPT_BLANKED = (LINE, BLOCK, DOUBLE, SINGLE, BACK)
NOT_FLOW = r"(?!(?:if|for|while|switch|catch|return|else|do|new|throw|case|function|await|typeof|using|lock|foreach|synchronized|sizeof|try|delete|goto|in|of|yield|get|set|import|export|super|this|with|assert)\b)"
ANNOTATED = r"(?:@[\w.]+(?:\([^()\n]*\))?\s+|\[[^\]\n]*\]\s*)*"
SCRIPT = (
    (r"\bfunction\b\s*\*?\s*(?P<name>[\w$]+)", "Function"),
    (r"\b(?:abstract\s+)?class\s+(?!extends\b)(?P<name>[\w$]+)", "Class"),
    (r"(?<![\w$.])(?:(?:const|let|var)\s+|(?<=[;{}\n])[ \t]*(?:[\w$]+\.)*)(?P<name>[\w$]+)\s*(?::[^=;\n]+?)?=\s*(?:async\s*)?(?:function\b\s*\*?\s*(?=\()|(?:\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=;{}]+?)?|[\w$]+)\s*=>)", "Function"),
)
SCRIPT_MEMBERS = (at_start(r"(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set|declare)\s+|\*\s*)*" + NOT_FLOW + r"(?P<name>#?[\w$]+)\s*(?:<[^<>()]*>)?\s*\((?=[^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^;{}=]+?(?:\{[^{}]*\})?)?\s*\{)"), "Method")
TYPESCRIPT = (
    (r"\binterface\s+(?P<name>[\w$]+)", "Interface"),
    (at_start(r"(?:export\s+)?(?:declare\s+)?type\s+(?P<name>[\w$]+)\s*(?:<[^=;]*>)?\s*=(?!>)"), "Type"),
    (r"\benum\s+(?P<name>[\w$]+)", "Type"),
)
SIGNATURES = (at_start(r"(?:(?:public|private|protected|static|abstract|readonly)\s+)*" + NOT_FLOW + r"(?P<name>[\w$]+)\??\s*(?:<[^<>()]*>)?\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*:\s*[^;{}=\n]+(?=;|\n)"), "Method")
SCRIPT_IMPORTS = found(r"""^[ \t]*import\s+(?:(?P<clause>[^'";]+?)\s+from\s+['"](?P<from>[^'"]+)['"]|['"](?P<bare>[^'"]+)['"])""", script_import)
TYPED_MEMBER = at_start(ANNOTATED + r"(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|sealed|async|synchronized|native|default|partial|extern|unsafe|readonly|new|strictfp)\s+)*(?:<[^<>]*(?:<[^<>]*>[^<>]*)*>\s*)?" + NOT_FLOW + r"(?:[\w.]+(?:<[^;(){}]*?>)?(?:\[\]|\?|\s*\*)*\s+)" + NOT_FLOW + r"(?P<name>\w+)\s*(?:<[^<>()]*>)?\s*\((?=[^()]*(?:\([^()]*\)[^()]*)*\)\s*(?:throws\s+[\w.,\s]+|where\s+[^{;]+)?(?:\{|;|=>))")
CONSTRUCTOR = at_start(ANNOTATED + r"(?:(?:public|private|protected|internal|static)\s+)*" + NOT_FLOW + r"(?P<name>[A-Z]\w*)\s*\((?=[^()]*(?:\([^()]*\)[^()]*)*\)\s*(?:throws\s+[\w.,\s]+|:\s*(?:base|this)\s*\([^{;]*\)\s*)?\{)")
C_FUNCTION = r"^(?!\s*(?:if|for|while|switch|return|else|do|typedef|struct\s+\w+\s*\{|using|namespace|case|new|delete|throw)\b)[ \t]*(?:[\w:<>,~&*\[\]]+[ \t*&]+)+?[*&]*(?:\w+::)*(?P<name>~?\w+)\s*\((?=[^();{}]*(?:\([^()]*\)[^();{}]*)*\)\s*(?:const\b|noexcept\b|override\b|final\b|->\s*[\w:<>*&]+|\s)*(?::[^;{}]*)?\{)"
END_OPENS = r"\b(?:class|module|def|begin|case|do)\b(?![?!:])|(?:^|[=;(])[ \t]*(?:if|unless|while|until|for)\b"

LANGUAGES = {
    "javascript": Language(SCRIPT_BLANKED, (*SCRIPT, SCRIPT_MEMBERS), SCRIPT_IMPORTS),
    "typescript": Language(SCRIPT_BLANKED, (*SCRIPT, *TYPESCRIPT, SCRIPT_MEMBERS, SIGNATURES), SCRIPT_IMPORTS),
    "go": Language(
        (LINE, BLOCK, DOUBLE, CHARACTER, BACK),
        ((r"^func\s*\((?P<receiver>[^)]*)\)\s*(?P<name>\w+)", "Method"), (r"^func\s+(?P<name>\w+)", "Function"), (r"\btype\s+(?P<name>\w+)(?=[\s\[])(?!\s*\()", "Type")),
        found(r"""^import\s+(?:(?P<one>(?:[\w.]+\s+)?"[^"]+")|\((?P<many>[^)]*)\))""", go_import),
        newline_ends=True,
    ),
    "rust": Language(
        (LINE, BLOCK, DOUBLE, CHARACTER),
        ((r"\bfn\s+(?P<name>\w+)", "Function"), (r"\bstruct\s+(?P<name>\w+)", "Class"), (r"\benum\s+(?P<name>\w+)", "Type"), (r"\btrait\s+(?P<name>\w+)", "Interface"),
         (r"^[ \t]*(?:unsafe\s+)?impl\b\s*(?:<[^{]*?>\s*)?(?:[\w:<>, ']+?\s+for\s+)?(?P<name>\w+)", "Class"), (r"\bmod\s+(?P<name>\w+)", "Type")),
        found(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", rust_import),
    ),
    "java": Language(
        (LINE, BLOCK, TRIPLE, DOUBLE, CHARACTER),
        ((r"(?<!@)\binterface\s+(?P<name>\w+)", "Interface"), (r"@interface\s+(?P<name>\w+)", "Interface"), (r"(?<!\.)\bclass\s+(?P<name>\w+)", "Class"), (r"\brecord\s+(?P<name>\w+)(?=\s*[<(])", "Class"), (r"\benum\s+(?P<name>\w+)", "Type"), (CONSTRUCTOR, "Function"), (TYPED_MEMBER, "Function")),
        found(r"^[ \t]*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", lambda m: [last_part(m[1])]), bare_calls=True, modifiers=True,
    ),
    "c": Language(C_BLANKED, ((r"\btypedef\b[^;{}]*(?:\{[^{}]*\})?[^;{}]*?(?P<name>\w+)\s*(?=;)", "Type"), (r"\bstruct\s+(?P<name>\w+)(?=\s*\{)", "Class"), (r"\benum\s+(?P<name>\w+)(?=\s*\{)", "Type"), (C_FUNCTION, "Function"))),
    "cpp": Language(
        C_BLANKED,
        ((r"(?<!enum )\b(?:class|struct)\s+(?:\w+\s+)??(?P<name>\w+)(?=\s*(?:final\s*)?(?::[^;{}]*)?\{)", "Class"), (r"\bnamespace\s+(?P<name>\w+)(?=[\w:\s]*\{)", "Type"), (r"\benum\s+(?:class\s+|struct\s+)?(?P<name>\w+)(?=[^;{]*\{)", "Type"), (C_FUNCTION, "Function")),
    ),
    "ruby": Language(
        (r"^=begin.*?^=end", HASH, DOUBLE, SINGLE),
        ((r"^[ \t]*class\s+(?:\w+::)*(?P<name>\w+)", "Class"), (r"^[ \t]*module\s+(?:\w+::)*(?P<name>\w+)", "Type"), (r"(?:^|;)[ \t]*(?:private\s+|public\s+|protected\s+)?def\s+(?:self\.|\w+\.)?(?P<name>\w+[?!=]?)", "Function")),
        opens=END_OPENS, closes=r"\bend\b(?![?!:])",
    ),
    "php": Language(
        (LINE, BLOCK, HASH, DOUBLE, SINGLE),
        ((r"(?<![:$\w>])class\s+(?P<name>\w+)", "Class"), (r"\binterface\s+(?P<name>\w+)", "Interface"), (r"\btrait\s+(?P<name>\w+)", "Type"), (r"\benum\s+(?P<name>\w+)(?=[^;(]*\{)", "Type"), (r"\bfunction\s+&?(?P<name>\w+)", "Function")),
        found(r"^[ \t]*use\s+(?:function\s+|const\s+)?([\w\\]+)(?:\s+as\s+(\w+))?\s*;", lambda m: [(m[1], [], "")]), plain_calls=True, modifiers=True,
    ),
    "c_sharp": Language(
        (LINE, BLOCK, TRIPLE, r'@"(?:""|[^"])*"', DOUBLE, CHARACTER),
        ((r"\binterface\s+(?P<name>\w+)", "Interface"), (r"(?<!record )\b(?:class|struct)\s+(?P<name>\w+)(?=[^;()]*\{)", "Class"), (r"\brecord\s+(?:class\s+|struct\s+)?(?P<name>\w+)(?=\s*[<({:;])", "Class"), (r"\benum\s+(?P<name>\w+)", "Type"), (CONSTRUCTOR, "Function"), (TYPED_MEMBER, "Function")),
        found(r"^[ \t]*(?:global\s+)?using\s+(?P<static>static\s+)?(?:(?P<alias>\w+)\s*=\s*)?(?P<path>[\w.]+)\s*;", sharp_import), modifiers=True,
    ),
    "bash": Language((HASH, r'"(?:\\.|[^"\\])*"', r"'[^']*'"), ((r"(?:^|;)[ \t]*function\s+(?P<name>[\w:-]+)", "Function"), (r"(?:^|;)[ \t]*(?P<name>[\w:-]+)\s*\(\s*\)(?=\s*\{)", "Function"))),
    "kotlin": Language(
        (LINE, BLOCK, TRIPLE, DOUBLE, CHARACTER),
        ((r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w<>?, ]+\.)?(?P<name>\w+)(?=\s*\()", "Function"), (r"(?<![:.])\b(?:class|object)\s+(?P<name>\w+)", "Class"), (r"\binterface\s+(?P<name>\w+)", "Interface"), (at_start(r"(?:\w+\s+)*(?P<name>constructor)(?=\s*\()"), "Function")),
        found(r"^[ \t]*import\s+(\w+(?:\.\w+)*(?:\.\*)?)(?:\s+as\s+(\w+))?", lambda m: [last_part(m[1], m[2] or "")]), newline_ends=True, modifiers=True,
    ),
    "swift": Language(
        (LINE, BLOCK, TRIPLE, DOUBLE),
        ((r"\bfunc\s+(?P<name>\w+)", "Function"), (r"(?<!import )\b(?:class|struct|actor)\s+(?!func\b|var\b|let\b)(?P<name>\w+)", "Class"), (r"(?<!import )\bprotocol\s+(?P<name>\w+)", "Interface"), (r"\benum\s+(?P<name>\w+)", "Type"), (at_start(r"(?:(?:public|private|internal|required|convenience|override)\s+)*(?P<name>init)[?!]?(?=\s*[(<])"), "Function")),
        found(r"^[ \t]*(?:@\w+\s+)?import\s+(?:(?P<kind>struct|class|enum|protocol|func|let|var|typealias)\s+)?(?P<path>[\w.]+)", lambda m: [last_part(m["path"]) if m["kind"] else (m["path"], [], "")]), newline_ends=True,
    ),
    "scala": Language(
        (LINE, BLOCK, TRIPLE, DOUBLE, CHARACTER),
        ((r"\bdef\s+(?P<name>\w+)", "Function"), (r"\b(?:class|object)\s+(?P<name>\w+)", "Class"), (r"\btrait\s+(?P<name>\w+)", "Interface"), (at_start(r"(?:(?:private|protected|implicit|lazy|override|final)\s+)*val\s+(?P<name>\w+)"), "Type")),
        found(r"^[ \t]*import\s+(?P<path>[\w.]+?(?:\._|\.\*|\.(?=\{))?)(?:\{(?P<group>[^}]*)\})?(?=\s|$|;)", scala_import), newline_ends=True, modifiers=True,
    ),
    "lua": Language(
        (r"--\[\[.*?(?:\]\]|\Z)", r"--[^\n]*", r"\[\[.*?\]\]", DOUBLE, SINGLE),
        ((r"\bfunction\s+(?:\w+[.:])*(?P<name>\w+)", "Function"), (r"(?:^|;)[ \t]*(?:local\s+)?(?:\w+\.)*(?P<name>\w+)\s*=\s*function\b", "Function")),
        opens=r"\b(?:function|do|if|repeat)\b", closes=r"\b(?:end|until)\b",
    ),
    "elixir": Language(
        (HASH, TRIPLE, DOUBLE, CHARACTER),
        ((r"^[ \t]*defmodule\s+(?:\w+\.)*(?P<name>\w+)", "Class"), (r"^[ \t]*defprotocol\s+(?:\w+\.)*(?P<name>\w+)", "Interface"), (r"^[ \t]*def(?:p|macro|macrop)?\s+(?P<name>\w+[?!]?)", "Function")),
        found(r"^[ \t]*(?:import|alias|require|use)\s+([\w.]+)", lambda m: [(m[1], [], "")]), opens=r"\bdo\b(?!:)|\bfn\b", closes=r"\bend\b(?!:)",
    ),
}
BLANKERS = {name: re.compile("|".join(f"(?:{p})" for p in lang.blanked), re.S | re.M) for name, lang in LANGUAGES.items()}
CALL = re.compile(r"(?P<chain>(?:\.|->|::)\s*)?(?<![\w$])(?P<callee>[A-Za-z_$][\w$]*[?!]?(?:(?:\?\.|\.|::|->|:)[A-Za-z_$][\w$]*[?!]?)*)(?:<[^<>()\n]*>)?\s*\(|(?P<again>[)\]])\s*\(")
VISIBILITY = ("private", "protected", "internal", "public")


def blank(source: str, language: str) -> str:
    return BLANKERS[language].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def brackets(code: str) -> dict[int, int]:
    """Position of each opening bracket to that of its closing one; what is left open closes at the end."""
    pairs, stack = {}, []
    for m in re.finditer(r"[(){}\[\]]", code):
        c = m[0]
        if c in "([{":
            stack.append(m.start())
        else:
            want = "([{"[")]}".index(c)]
            while stack and code[stack[-1]] != want and want == "{":  # brackets that are never closed inside a block
                pairs[stack.pop()] = m.start()
            if stack and code[stack[-1]] == want:
                pairs[stack.pop()] = m.start()
    return pairs | {at: len(code) for at in stack}


def blocks(code: str, lang: Language) -> list[tuple[int, int]]:
    """(start of the opening word, end of the closing one) where blocks end with a word."""
    out, stack, words = [], [], re.compile(f"(?P<o>{lang.opens})|(?P<c>{lang.closes})", re.M)
    loop_at = -1
    for m in words.finditer(code):
        if m["o"] is None:
            if stack:
                out.append((stack.pop(), m.end()))
            continue
        word = re.search(r"\w+$", m["o"])[0]
        if word == "do" and loop_at >= 0 and "\n" not in code[loop_at : m.start()]:  # belongs to the loop before it
            loop_at = -1
            continue
        if word == "def" and re.match(r"\s+[\w.]+[?!]?\s*(?:\([^)\n]*\))?\s*=(?![=~>])", code[m.end() : m.end() + 300]):  # a body of one expression
            continue
        if word in ("while", "until", "for"):
            loop_at = m.start()
        stack.append(m.end() - len(word))
    return out + [(at, len(code)) for at in stack]


def body(code: str, at: int, newline_ends: bool, pairs: dict[int, int]) -> tuple[int, int]:
    """(where the body opens, where the definition ends), from behind the name."""
    stop = re.compile(r"[({\[;\n]" if newline_ends else r"[({\[;]")
    while m := stop.search(code, at):
        c, k = m[0], m.start()
        if c == "{":
            return k, min(pairs.get(k, len(code)) + 1, len(code))
        if c == ";":
            return k, k
        if c == "\n":
            after = re.compile(r"\s*([{:.]|where\b|extends\b|with\b)").match(code, k)
            if not after:
                return k, k
            at = after.start(1) + (after[1] != "{")
            continue
        at = pairs.get(k, len(code)) + 1
    return len(code), len(code)


def symbols(source: str, language: str) -> tuple[list[dict], list[dict]]:
    """Definitions in order, and the imports of the file.  Nothing is raised for broken sources."""
    lang, code = LANGUAGES[language], blank(source, language)
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    line = lambda at: bisect_right(starts, at)
    texts = source.split("\n")
    pairs = {} if lang.opens else brackets(code)
    ends = dict(blocks(code, lang)) if lang.opens else {}
    hits = []
    for m in lang.pattern.finditer(code):
        k = next(k for k in range(len(lang.definitions)) if m[f"d{k}"] is not None)
        name_at = m.start(f"n{k}")
        begin = m.start() + len(m[0]) - len(m[0].lstrip(" \t\n;"))
        if lang.opens:
            word = re.compile(r"\b(?:class|module|def|function)\b").search(code, begin, m.end())
            do = re.compile(r"\bdo\b(?!:)").search(code, m.end(), (code.find("\n", m.end()) + 1 or len(code)))
            opener = do.start() if language == "elixir" and do else word.start() if word and language != "elixir" else -1
            close = ends.get(opener, code.find("\n", m.end()) if "\n" in code[m.end() :] else len(code))
            newline = code.find("\n", m.end())
            opened = min(close, newline if newline >= 0 else len(code))
        else:
            expression = m[0].endswith("=>") and not code[m.end() : m.end() + 200].lstrip().startswith("{")
            opened, close = body(code, m.end() - m[0].endswith("("), lang.newline_ends or expression, pairs)
            if lang.definitions[k] in SIGNATURES or lang.definitions[k][0].startswith(r"\btypedef"):
                opened = close = m.end()
        hits.append((begin, close, opened, source[name_at : m.end(f"n{k}")], lang.definitions[k][1], m))
    hits.sort(key=lambda h: (h[0], -h[1]))
    rows: list[dict] = []
    stack: list[tuple[int, int]] = []  # (end, index of row)
    nested: list[list[tuple[int, int]]] = []
    behinds: list[int] = []  # ends of the names, from where calls count in a body without brackets
    for begin, close, opened, name, label, m in hits:
        while stack and stack[-1][0] <= begin:
            stack.pop()
        around = [i for _, i in stack]
        owner = next((rows[i] for i in reversed(around) if rows[i]["label"] in CLASS_LIKE), None)
        if language == "scala" and label == "Type" and any(rows[i]["label"] == "Function" for i in around):
            continue  # a local value
        parent = owner["name"] if owner else ""
        receiver = (m.groupdict().get("receiver") or "").strip()
        if receiver:
            parent = re.sub(r"\[.*", "", receiver.split()[-1].lstrip("*"))
        if language == "php" and label == "Function" and owner:
            label = "Method"
        first, last = line(begin), line(max(begin, close - 1))
        head_last = line(max(begin, opened - 1)) if opened < close else last
        if opened < close and line(opened) == first:
            head = texts[first - 1]
        else:
            head = "\n".join(texts[first - 1 : max(first, line(opened) - 1 if opened < close and source[starts[line(opened) - 1] : opened].strip() == "" else head_last)])
        words = code[begin : m.end()]
        line_words = code[max(code.rfind(c, 0, begin) for c in ";{}\n") + 1 : m.end()]
        visible = next((v for v in VISIBILITY if lang.modifiers and re.search(rf"\b{v}\b", line_words)), "")
        returns = re.search(r"\)\s*(?:->|:)\s*([^{;=\n]+)", code[m.start() : opened]) if label in ("Function", "Method") else None
        rows.append(
            {
                "name": name, "label": label, "parent": parent, "start_line": first, "end_line": last, "signature": " ".join(head.split()), "source": "\n".join(texts[first - 1 : last]), "decorators": decorators(texts, first) if language in ("javascript", "typescript") else [],
                "is_async": bool(re.search(r"\basync\b", words)), "receiver": receiver, "visibility": visible, "is_static": lang.modifiers and bool(re.search(r"\bstatic\b", line_words)),
                "is_abstract": lang.modifiers and bool(re.search(r"\babstract\b", line_words)), "return_type": returns[1].strip() if returns else "", "calls": [], "imports": [], "unsupported_calls": 0,
            }
        )
        nested.append([(opened, close)])
        behinds.append(m.end())
        if around:
            nested[around[-1]].append((begin, close))
        stack.append((close, len(rows) - 1))
    for row, behind, ((opened, close), *inner) in zip(rows, behinds, nested, strict=True):
        if row["label"] in ("Type", "Interface"):
            continue  # what looks like a call declares
        at = opened if opened < close else behind
        for a, b in [*sorted(inner), (close, close)]:
            if at < a:
                add_calls(row, code, at, a, lang, line, language)
            at = max(at, b)
    return rows, placed_imports(rows, nested, lang.imports(source), line, code)


def decorators(texts: list[str], first: int) -> list[str]:
    """Decorators on the lines above, without their sign."""
    found = []
    while first > 1 and texts[first - 2].strip().startswith("@"):
        first -= 1
        found.insert(0, texts[first - 1].strip()[1:])
    return found


def add_calls(row: dict, code: str, begin: int, end: int, lang: Language, line: Callable[[int], int], language: str) -> None:
    for m in CALL.finditer(code, begin, end):
        if m["again"]:
            row["unsupported_calls"] += 1
            continue
        callee = m["callee"].replace("?.", ".")
        before = code[max(0, m.start("callee") - 5) : m.start("callee")]
        if callee[-1] in "?!" and language not in ("ruby", "elixir"):
            continue
        if re.split(r"\W", callee)[0] in NO_CALL or callee == "this" or re.search(r"\bnew\s+$", before):
            continue
        if lang.bare_calls:
            callee = callee.rpartition(".")[2]
        elif m["chain"]:
            if not lang.plain_calls:
                row["unsupported_calls"] += 1
            continue
        elif lang.plain_calls and re.search(r"->|::", callee):
            continue
        row["calls"].append({"callee": callee, "line": line(m.start("callee")), "qualifier": callee.rpartition(".")[0]})
    if language == "rust":
        row["unsupported_calls"] += len(re.findall(r"\w!\s*[(\[{]", code[begin:end]))


def placed_imports(rows: list[dict], nested: list, imports: list, line: Callable[[int], int], code: str) -> list[dict]:
    """Imports inside a definition go to the innermost one; the rest, in order, are the file's."""
    outside = []
    for at, module, names, alias in imports:
        first = at + len(code[at:]) - len(code[at:].lstrip()) if code[at : at + 1].isspace() else at
        if not code[first : first + 1].strip():
            continue  # in a comment or a string
        item = {"module_path": module, "names": names, "alias": alias, "line": line(first)}
        holder = [row for row, spans in zip(rows, nested, strict=True) if spans[0][0] < at < spans[0][1]]
        (holder[-1]["imports"] if holder else outside).append(item)
    return outside
