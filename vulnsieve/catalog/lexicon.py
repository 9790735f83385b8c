"""Fixed values of the lexer and the vocabulary."""

from __future__ import annotations

# ── fixed values: token types ───────────────────────────────────────────────
TOKEN_TYPES = [
    "keyword", "identifier", "literal", "operator", "delimiter",
    "comment", "string", "number", "whitespace", "unknown",
]

# ── fixed values: keywords per language ─────────────────────────────────────
KEYWORDS = {
    "python": [
        "False", "None", "True", "and", "as", "assert", "async", "await", "break", "class", "continue", "def", "del",
        "elif", "else", "except", "finally", "for", "from", "global", "if", "import", "in", "is", "lambda", "nonlocal",
        "not", "or", "pass", "raise", "return", "try", "while", "with", "yield",
    ],
    "javascript": [
        "abstract", "arguments", "await", "boolean", "break", "byte", "case", "catch", "char", "class", "const",
        "continue", "debugger", "default", "delete", "do", "double", "else", "enum", "eval", "export", "extends", "false",
        "final", "finally", "float", "for", "function", "goto", "if", "implements", "import", "in", "instanceof", "int",
        "interface", "let", "long", "native", "new", "null", "package", "private", "protected", "public", "return",
        "short", "static", "super", "switch", "synchronized", "this", "throw", "throws", "transient", "true", "try",
        "typeof", "var", "void", "volatile", "while", "with", "yield",
    ],
    "java": [
        "abstract", "assert", "boolean", "break", "byte", "case", "catch", "char", "class", "const", "continue", "default",
        "do", "double", "else", "enum", "extends", "false", "final", "finally", "float", "for", "goto", "if", "implements",
        "import", "instanceof", "int", "interface", "long", "native", "new", "null", "package", "private", "protected",
        "public", "return", "short", "static", "strictfp", "super", "switch", "synchronized", "this", "throw", "throws",
        "transient", "true", "try", "void", "volatile", "while",
    ],
    "c_cpp": [
        "auto", "break", "case", "char", "const", "continue", "default", "do", "double", "else", "enum", "extern", "float",
        "for", "goto", "if", "inline", "int", "long", "register", "restrict", "return", "short", "signed", "sizeof",
        "static", "struct", "switch", "typedef", "union", "unsigned", "void", "volatile", "while", "alignas", "alignof",
        "bool", "catch", "class", "constexpr", "decltype", "delete", "dynamic_cast", "explicit", "export", "false",
        "friend", "mutable", "namespace", "new", "noexcept", "nullptr", "operator", "private", "protected", "public",
        "reinterpret_cast", "static_assert", "static_cast", "template", "this", "throw", "true", "try", "typeid",
        "typename", "using", "virtual",
    ],
    "go": [
        "break", "case", "chan", "const", "continue", "default", "defer", "else", "fallthrough", "for", "func", "go",
        "goto", "if", "import", "interface", "map", "package", "range", "return", "select", "struct", "switch", "type",
        "var",
    ],
    "rust": [
        "as", "async", "await", "break", "const", "continue", "crate", "dyn", "else", "enum", "extern", "false", "fn",
        "for", "if", "impl", "in", "let", "loop", "match", "mod", "move", "mut", "pub", "ref", "return", "self", "Self",
        "static", "struct", "super", "trait", "true", "type", "unsafe", "use", "where", "while",
    ],
    "php": [
        "abstract", "and", "array", "as", "break", "callable", "case", "catch", "class", "clone", "const", "continue",
        "declare", "default", "die", "do", "echo", "else", "elseif", "empty", "enddeclare", "endfor", "endforeach",
        "endif", "endswitch", "endwhile", "eval", "exit", "extends", "false", "final", "finally", "fn", "for", "foreach",
        "function", "global", "goto", "if", "implements", "include", "include_once", "instanceof", "insteadof",
        "interface", "isset", "list", "match", "namespace", "new", "null", "or", "print", "private", "protected", "public",
        "readonly", "require", "require_once", "return", "static", "switch", "throw", "trait", "true", "try", "unset",
        "use", "var", "while", "xor", "yield",
    ],
    "ruby": [
        "BEGIN", "END", "alias", "and", "begin", "break", "case", "class", "def", "defined?", "do", "else", "elsif", "end",
        "ensure", "false", "for", "if", "in", "module", "next", "nil", "not", "or", "redo", "rescue", "retry", "return",
        "self", "super", "then", "true", "undef", "unless", "until", "when", "while", "yield",
    ],
}

# ── fixed values: security-sensitive words ──────────────────────────────────
SENSITIVE = [
    "eval", "exec", "system", "popen", "subprocess", "os.system", "os.popen", "pickle.loads", "yaml.load", "marshal.loads",
    "input", "raw_input", "scanf", "gets", "strcpy", "strcat", "sprintf", "printf", "fprintf", "mysql_query", "query",
    "execute", "cursor", "innerHTML", "document.write", "dangerouslySetInnerHTML", "child_process", "shell_exec",
    "passthru", "proc_open", "assert", "unserialize", "deserialize", "fromJson", "readFile", "writeFile", "open", "chmod",
    "chown", "request", "fetch", "XMLHttpRequest", "crypto", "md5", "sha1", "rand", "random", "Math.random", "SECRET",
    "PASSWORD", "API_KEY", "TOKEN", "PRIVATE_KEY", "credentials",
]

# ── fixed values: special tokens, common tokens, subword fragments ──────────
SPECIAL_TOKENS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[VULN]", "[SAFE]"]
COMMON_TOKENS = [
    "+", "-", "*", "/", "%", "=", "==", "!=", "<", ">", "<=", ">=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=",
    ">>=", "&&", "||", "!", "&", "|", "^", "~", "<<", ">>", "(", ")", "{", "}", "[", "]", ";", ",", ".", ":", "::", "->",
    "=>", "...", "?.", "?", "@", "#", "++", "--", "**", "\\n", "\\t", "\\r", "\\\\", "\\\"", "\\'", "int", "str", "float",
    "bool", "list", "dict", "tuple", "set", "string", "number", "boolean", "object", "any", "void", "null", "undefined",
    "None", "true", "false", "True", "False",
]
SUBWORDS = [
    "##ing", "##tion", "##er", "##ed", "##ly", "##ment", "##ness", "##able", "##ible", "##ful", "##less", "##ize", "##ise",
    "##ous", "##ive", "##al", "re##", "un##", "pre##", "dis##", "over##", "get_", "set_", "is_", "has_", "can_", "do_",
    "_id", "_name", "_type", "_size", "_count", "_list", "_data", "_info", "_config", "_path", "_file", "_dir", "_key",
    "_value", "_index", "_error", "_result", "_input", "_output", "_handler", "_callback", "_request", "_response",
    "_session", "_token", "_url", "_host", "_port", "_user", "_pass",
]
VOCABULARY_SIZE = 32_000
MAX_LENGTH = 2_048

# ── fixed values: the lexer, alternatives in order ──────────────────────────
# Strings are written possessively, which matches the same texts without deep
# recursion in Java; ``PORTABLE_STRING`` is the plain form.
_REST = (
    r"|//.*?$|\#.*?$|/\*[\s\S]*?\*/"  # comments
    r"|0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+"  # numbers
    r"|\d+\.\d*(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?"
    r"|[+\-*/%&|^~<>!=]=?|<<|>>|&&|\|\||\+\+|--|->|=>|::|\.\.\.|\?\.|[?:]"  # operators
    r"|[(){}\[\];,\.@]"  # delimiters
    r"|[a-zA-Z_$][a-zA-Z0-9_$]*"  # identifiers
    r"|\s+|."  # blanks, anything else
)
_TRIPLE = r'"""[\s\S]*?"""' + r"|'''[\s\S]*?'''"
TOKEN_PATTERN = "(?md)" + _TRIPLE + r'|"(?:[^"\\]++|\\.)*+"' + r"|'(?:[^'\\]++|\\.)*+'" + _REST
PORTABLE_TOKEN_PATTERN = "(?m)" + _TRIPLE + r'|"(?:[^"\\]|\\.)*"' + r"|'(?:[^'\\]|\\.)*'" + _REST
# ── end of fixed values ─────────────────────────────────────────────────────

ALL_KEYWORDS = sorted({word for words in KEYWORDS.values() for word in words})
SENSITIVE_WORDS = sorted(SENSITIVE)
BLANKS = " \t\n\r\f\x0b"

# ``TOKEN_PATTERN`` for extraction: group 1 is the token, blanks after it are passed over.  Words come first: no
# other alternative but the last starts like one, so the order among them does not matter.
_WORD = r"[a-zA-Z_$][a-zA-Z0-9_$]*"
EXTRACT_PATTERN = "(?md)(" + _WORD + "+|" + TOKEN_PATTERN.removeprefix("(?md)").replace(f"|{_WORD}|\\s+|.", r"|\S") + r")\s*+"


def vocabulary_words(identifiers: list[str] = (), size: int = VOCABULARY_SIZE) -> list[str]:
    """The vocabulary in id order, padded with placeholders to ``size``.

    Specials, keywords, sensitive words, common tokens, the given identifiers,
    printable ASCII, subword fragments; a word keeps the place it has first.
    """
    blocks = [
        SPECIAL_TOKENS, ALL_KEYWORDS, SENSITIVE_WORDS, COMMON_TOKENS, identifiers,
        [chr(c) for c in range(32, 127)], SUBWORDS,
    ]
    words = list(dict.fromkeys(word for block in blocks for word in block))
    return words + [f"[UNUSED_{i}]" for i in range(len(words), size)]
