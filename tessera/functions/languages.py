"""Fixed values of the two source languages: keywords, punctuation and literal forms, and the tiling patterns made of them."""

from __future__ import annotations

from dataclasses import dataclass, field

# Words that count as keywords in statistics.
GO_KEYWORDS = [
    "break", "case", "chan", "const", "continue", "default", "defer", "else", "fallthrough", "for", "func", "go", "goto", "if",
    "import", "interface", "map", "package", "range", "return", "select", "struct", "switch", "type", "var",
    "nil", "true", "false", "iota", "error", "string", "int", "int8", "int16", "int32", "int64", "uint", "uint8", "uint16", "uint32",
    "uint64", "uintptr", "byte", "rune", "float32", "float64", "complex64", "complex128", "bool", "any", "append", "cap", "close",
    "copy", "delete", "len", "make", "new", "panic", "print", "println", "recover", "min", "max", "clear",
]
CSHARP_KEYWORDS = [
    "abstract", "as", "base", "bool", "break", "byte", "case", "catch", "char", "checked", "class", "const", "continue", "decimal",
    "default", "delegate", "do", "double", "else", "enum", "event", "explicit", "extern", "false", "finally", "fixed", "float", "for",
    "foreach", "goto", "if", "implicit", "in", "int", "interface", "internal", "is", "lock", "long", "namespace", "new", "null",
    "object", "operator", "out", "override", "params", "private", "protected", "public", "readonly", "ref", "return", "sbyte",
    "sealed", "short", "sizeof", "stackalloc", "static", "string", "struct", "switch", "this", "throw", "true", "try", "typeof",
    "uint", "ulong", "unchecked", "unsafe", "ushort", "using", "virtual", "void", "volatile", "while",
    "var", "async", "await", "yield", "get", "set", "init", "record", "where", "select", "from", "nameof", "when", "with", "required",
]
# Operators, and what a line break after which Go reads a semicolon.
PUNCTUATION = [
    ">>>=", "<<=", ">>=", "...", "??=", "?.", "->", "=>", "::", "++", "--", "&&", "||", "<-", ":=",
    "==", "!=", "<=", ">=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<", ">>", "&^", "??",
    "+", "-", "*", "/", "%", "&", "|", "^", "!", "~", "<", ">", "=", "?", ":", ";", ",", ".", "(", ")", "[", "]", "{", "}",
]
SEMICOLON_KEYWORDS = ["break", "continue", "fallthrough", "return", "true", "false", "nil", "iota"]
SEMICOLON_PUNCTUATION = ["++", "--", ")", "]", "}"]

SPACE = r"[\x09\x0B-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ESCAPED = {c: "\\" + c for c in r"+*?^|.()[]{}$"}


def _quoted(text: str) -> str:
    return "".join(_ESCAPED.get(c, c) for c in text)


def punctuation_pattern() -> str:
    return "|".join(_quoted(p) for p in sorted(PUNCTUATION, key=len, reverse=True))


@dataclass(frozen=True)
class Language:
    """What the tiling lexer needs to know; ``strings`` are patterns in order of preference."""

    name: str
    extensions: tuple[str, ...]
    keywords: tuple[str, ...]
    strings: tuple[str, ...]
    number: str = r"\.?\p{Nd}[\p{L}\p{Nd}_.]*(?:(?<=[eEpP])[+-][\p{L}\p{Nd}_.]*)*"
    auto_semicolon: bool = False
    line_directive: str = ""
    rank_features: tuple[str, ...] = field(default=())

    @property
    def tiling(self) -> str:
        """Alternatives that together match every character, so pieces tile the text."""
        parts = [r"\n"]
        if self.line_directive:
            parts.append(self.line_directive)
        parts += [f"{SPACE}+", r"//[^\n]*", r"/\*(?s:.*?)(?:\*/|\z)", *self.strings, r"'[^'\\\n]*(?:\\(?s:.)[^'\\\n]*)*'?", self.number, r"@?[\p{L}_][\p{L}\p{Nd}_]*", punctuation_pattern(), r"(?s:.)"]
        return "|".join(parts)


_PLAIN_STRING = r'"[^"\\\n]*(?:\\(?s:.)[^"\\\n]*)*"?'
_RAW_STRING = r'("{3,}+)(?s:.*?)(?:\1|\z)'

GO = Language("go", (".go",), tuple(GO_KEYWORDS), (_RAW_STRING, _PLAIN_STRING, r"`[^`]*`?"), auto_semicolon=True)
CSHARP = Language(
    "csharp", (".cs",), tuple(CSHARP_KEYWORDS),
    (r"[@$]{0,2}" + _RAW_STRING, r'(?:\$@|@[@$]?)"[^"]*(?:""[^"]*)*"?', r"\${0,2}" + _PLAIN_STRING),
    line_directive=r"(?m:^[ \t]*#[^\n]*)",
)
#: Text without language: no raw strings, no semicolons; its tiling has no look-around, so other regex engines agree.
PROSE = Language("prose", (), tuple(GO_KEYWORDS), (_PLAIN_STRING, r"`[^`]*`?"), number=r"\.?\p{Nd}(?:[eEpP][+-]|[\p{L}\p{Nd}_.])*")
LANGUAGES = {x.name: x for x in (GO, CSHARP, PROSE)}
