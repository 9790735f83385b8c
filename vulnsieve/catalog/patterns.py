"""Fixed values for language, framework, flow and reverse-engineering checks.

Every row that holds a pattern ends with an anchor test of ours (see
``catalog.rules``); anchors here are compared with the text as it is, so they are
case-sensitive unless the pattern ignores case.
"""

from __future__ import annotations

# ── fixed values: file extension -> language ────────────────────────────────
EXTENSION_LANGUAGE = {
    ".py": "python",
    ".js": "javascript", ".jsx": "javascript", ".ts": "javascript", ".tsx": "javascript",
    ".java": "java",
    ".c": "c", ".h": "c",
    ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".cxx": "cpp",
    ".php": "php", ".rb": "ruby", ".go": "go", ".rs": "rust",
}

# ── fixed values: directories never scanned ─────────────────────────────────
SKIP_DIRS = [
    "node_modules", ".git", "__pycache__", ".venv", "venv", "env", ".env", "dist", "build",
    ".tox", ".mypy_cache", ".pytest_cache", "vendor", "target", "bin", "obj",
    ".idea", ".vscode", ".vs", "coverage", ".next",
]

# ── fixed values: language by content (pattern, anchor), in tie order ───────
CONTENT_LANGUAGE = {
    "python": [(r"def\s+\w+\s*\(", "def"), (r"import\s+\w+", "import"),
               (r"class\s+\w+\s*:", "class"), (r"print\s*\(", "print")],
    "javascript": [(r"function\s+\w+\s*\(", "function"), (r"const\s+\w+\s*=", "const"),
                   (r"let\s+\w+\s*=", "let"), (r"=>\s*\{", "=>")],
    "java": [(r"public\s+class", "public"), (r"public\s+static\s+void\s+main", "public"),
             (r"System\.out\.", "System.out.")],
    "c": [(r"#include\s*<", "#include"), (r"int\s+main\s*\(", "main"),
          (r"printf\s*\(", "printf"), (r"malloc\s*\(", "malloc")],
    "cpp": [(r"#include\s*<iostream>", "<iostream>"), (r"std::", "std::"),
            (r"cout\s*<<", "cout"), (r"namespace\s+\w+", "namespace")],
    "go": [(r"package\s+\w+", "package"), (r"func\s+\w+\s*\(", "func"),
           (r"fmt\.\w+", "fmt."), (r"go\s+func", "func")],
    "rust": [(r"fn\s+\w+\s*\(", "fn"), (r"let\s+mut\s+", "let"),
             (r"impl\s+\w+", "impl"), (r"use\s+std::", "std::")],
    "php": [(r"<\?php", "<?php"), (r"\$\w+\s*=", "$"),
            (r"function\s+\w+\s*\(.*\)\s*\{", "function")],
    "ruby": [(r"def\s+\w+", "def"), (r"class\s+\w+\s*<", "class"),
             (r"require\s+['\"]", "require"), (r"puts\s+", "puts")],
}

# ── fixed values: frameworks (patterns; anchors of ours), in order ──────────
FRAMEWORKS = {
    "django": ([r"from\s+django", r"import\s+django", r"DJANGO_SETTINGS_MODULE", r"urls\.py", r"views\.py"],
               ["django", "DJANGO_SETTINGS_MODULE", "urls.py", "views.py"]),
    "flask": ([r"from\s+flask\s+import", r"Flask\s*\(", r"@app\.route"],
              ["flask", "Flask", "@app.route"]),
    "fastapi": ([r"from\s+fastapi\s+import", r"FastAPI\s*\(", r"@app\.(get|post|put|delete|patch)"],
                ["fastapi", "FastAPI", "@app."]),
    "express": ([r"require\s*\(\s*['\"]express['\"]\s*\)", r"express\s*\(\s*\)",
                 r"app\.(get|post|put|delete|patch|use)\s*\("],
                ["express", "app."]),
    "react": ([r"import\s+React", r"from\s+['\"]react['\"]", r"useState|useEffect|useContext", r"ReactDOM"],
              ["React", "react", "useState", "useEffect", "useContext"]),
    "spring": ([r"@SpringBootApplication", r"@RestController", r"@RequestMapping", r"import\s+org\.springframework"],
               ["@SpringBootApplication", "@RestController", "@RequestMapping", "org.springframework"]),
    "rails": ([r"class\s+\w+\s*<\s*ApplicationController", r"ActiveRecord::Base", r"Rails\.application"],
              ["ApplicationController", "ActiveRecord::Base", "Rails.application"]),
    "laravel": ([r"use\s+Illuminate", r"class\s+\w+\s+extends\s+Controller", r"Route::(get|post|put|delete)"],
                ["Illuminate", "Controller", "Route::"]),
    "gin": ([r"\"github\.com/gin-gonic/gin\"", r"gin\.Default\(\)", r"gin\.New\(\)"],
            ["github.com/gin-gonic/gin", "gin.Default()", "gin.New()"]),
    "actix": ([r"use\s+actix_web", r"HttpServer::new", r"#\[actix_web::main\]"],
              ["actix_web", "HttpServer::new"]),
}

# ── fixed values: security-relevant imports (pattern, message, anchor) ──────
IMPORTS = {
    "python": [
        (r"import\s+(pickle|shelve|marshal)", "Unsafe serialization library imported", "import"),
        (r"from\s+xml\.etree.*?import", "XML parser may be vulnerable to XXE", "xml.etree"),
        (r"import\s+subprocess", "subprocess module — ensure safe usage", "subprocess"),
        (r"from\s+Crypto\.Cipher\s+import\s+DES", "DES cipher imported — use AES", "Crypto.Cipher"),
        (r"import\s+hashlib", "hashlib — ensure strong algorithms are used", "hashlib"),
        (r"import\s+random(?!\s*#.*?secure)", "random module — use secrets for security", "random"),
    ],
    "javascript": [
        (r"""require\s*\(\s*['"]child_process['"]\s*\)""", "child_process — risk of command injection", "child_process"),
        (r"""require\s*\(\s*['"]vm['"]\s*\)""", "vm module — risk of code injection", "require"),
        (r"""require\s*\(\s*['"]eval['"]\s*\)""", "eval module imported", "require"),
    ],
}

# ── fixed values: dangerous calls (name, class, severity, message) ──────────
DANGEROUS_CALLS = {
    "python": [
        ("exec", 2, "critical", "exec() can execute arbitrary code"),
        ("eval", 2, "critical", "eval() can execute arbitrary expressions"),
        ("compile", 2, "medium", "compile() dynamically creates code objects"),
        ("__import__", 2, "high", "Dynamic import can load arbitrary modules"),
        ("pickle.loads", 5, "critical", "pickle deserialization is unsafe"),
        ("pickle.load", 5, "critical", "pickle deserialization is unsafe"),
        ("os.system", 2, "critical", "os.system executes shell commands"),
        ("os.popen", 2, "critical", "os.popen executes shell commands"),
    ],
    "javascript": [
        ("eval", 2, "critical", "eval() executes arbitrary JavaScript"),
        ("Function", 2, "high", "Function constructor creates dynamic functions"),
        # the two names below are looked up literally, brackets included
        ("setTimeout(string)", 2, "high", "setTimeout with string arg is like eval"),
        ("setInterval(string)", 2, "high", "setInterval with string arg is like eval"),
    ],
    "php": [
        ("eval", 2, "critical", "eval() executes arbitrary PHP code"),
        ("assert", 2, "high", "assert() can execute code in older PHP"),
        ("preg_replace", 2, "high", "preg_replace /e modifier executes code"),
        ("extract", 9, "high", "extract() overwrites variables from array"),
    ],
}
DANGEROUS_CALL_CONFIDENCE = 0.7

# ── fixed values: user-input sources (pattern, anchor) ──────────────────────
FLOW_SOURCES = {
    "python": [(r"request\.\w+", "request."), (r"input\s*\(", "input"),
               (r"sys\.argv", "sys.argv"), (r"os\.environ", "os.environ")],
    "javascript": [(r"req\.\w+", "req."), (r"request\.\w+", "request."), (r"process\.argv", "process.argv"),
                   (r"document\.(?:location|URL|cookie)", "document."), (r"window\.location", "window.location")],
    "php": [(r"\$_(?:GET|POST|REQUEST|COOKIE|SERVER|FILES)\[", "$_"), (r"\$_SESSION\[", "$_SESSION[")],
}

# ── fixed values: sinks (pattern, class, message, anchor) ───────────────────
FLOW_SINKS = {
    "python": [
        (r"cursor\.execute\s*\(", 0, "User input may reach database query", "cursor.execute"),
        (r"os\.system\s*\(", 2, "User input may reach system command", "os.system"),
        (r"subprocess\.\w+\s*\(", 2, "User input may reach subprocess", "subprocess."),
        (r"open\s*\(", 3, "User input may reach file operation", "open"),
        (r"eval\s*\(", 2, "User input may reach eval()", "eval"),
        (r"render_template_string\s*\(", 1, "User input may reach template rendering", "render_template_string"),
    ],
    "javascript": [
        (r"\.query\s*\(", 0, "User input may reach database query", ".query"),
        (r"exec\s*\(", 2, "User input may reach command execution", "exec"),
        (r"innerHTML\s*=", 1, "User input may reach innerHTML", "innerHTML"),
        (r"eval\s*\(", 2, "User input may reach eval()", "eval"),
        (r"res\.send\s*\(", 1, "User input may reach response body", "res.send"),
    ],
    "php": [
        (r"mysql(?:i)?_query\s*\(", 0, "User input may reach SQL query", "_query"),
        (r"shell_exec\s*\(", 2, "User input may reach shell command", "shell_exec"),
        (r"echo\s+", 1, "User input may reach HTML output", "echo"),
        (r"include\s*\(", 3, "User input may reach include path", "include"),
    ],
}
FLOW_CONFIDENCE = 0.6

# ── fixed values: absence checks (framework or language, lower-case words all
#    absent, exact words all absent, lower-case word present, severity, message)
MISSING_CONTROLS = [
    ("django", ["csrf"], [], None, "medium", "Django: No CSRF protection references found"),
    ("django", [], ["SECURE_SSL_REDIRECT"], "settings", "medium", "Django: SECURE_SSL_REDIRECT not configured"),
    ("flask", ["csrf"], [], None, "medium", "Flask: No CSRF protection (consider Flask-WTF)"),
    ("express", ["helmet"], [], None, "low", "Express: Consider using helmet for security headers"),
    ("express", ["cors"], [], None, "low", "Express: CORS configuration not detected"),
    ("express", ["rate", "limit"], [], None, "medium", "Express: No rate limiting detected"),
    ("language:python", ["logger"], ["logging"], None, "low",
     "No logging configuration — security events may go unrecorded"),
]
MISSING_CONTROL_CONFIDENCE = 0.5
MISSING_CONTROL_CLASS = 9

# ── fixed values: reverse-engineering checks ────────────────────────────────
REVERSE_CONFIDENCE = 0.6
BINARY_SUFFIXES = [".pyc", ".so", ".dll", ".exe", ".bin", ".class"]
BINARY_MARKERS = ["password=", "secret=", "api_key=", "bearer "]
BINARY_HEAD_BYTES = 1024
BINARY_STRING = r"[ -~]{4,}"
BINARY_MESSAGE = "Potential hardcoded secret found in binary: '{}...'"

API_LANGUAGES = ["python", "javascript", "php"]
API_ROUTE_WORDS = ["route", "endpoint"]
API_AUTH_WORDS = ["auth", "login", "token"]
API_MESSAGE = "API endpoint inferred without clear authentication/authorization mechanisms."

ENDPOINTS = [  # pattern with the path as group 1, anchor
    (r"""@app\.route\(['"]([^'"]+)['"]\)""", "@app.route("),
    (r"""app\.(?:get|post|put|delete|patch)\(['"]([^'"]+)['"]\)""", "app."),
    (r"""@(?:GetMapping|PostMapping|PutMapping|DeleteMapping|RequestMapping)\(['"]([^'"]+)['"]\)""", "Mapping("),
]
ENDPOINT_SENSITIVE = ["admin", "internal", "debug"]
ENDPOINT_MESSAGE = "Potentially sensitive endpoint discovered: "

HIDDEN_ROUTES = [  # pattern, message, anchor (lower case); dot matches all
    (r"if\s+(?:DEBUG|is_debug|debug_mode|TESTING).*?:.*?(route|endpoint|path)",
     "Hidden route protected only by debug/testing flag", ": debug|testing route|endpoint|path"),
    (r"x-custom-debug-header", "Hidden route triggered by custom header", "x-custom-debug-header"),
    (r"(?:test|dev|debug|internal|admin)_api", "Hidden/Internal API route naming convention detected", "_api"),
]
HIDDEN_MESSAGE = "Hidden route/logic detected: "

DECOMPILED = [  # pattern, message, anchor
    (r"0x[0-9a-fA-F]+", "Hardcoded memory address or magic number detected (often found in decompiled logic)", "0x"),
    (r"goto\s+\w+;", "Goto statement detected (often a result of decompilation, indicates complex control flow)", "goto"),
]
DECOMPILED_MESSAGE = "Decompiled logic artifact: "

# ── fixed values: function patterns (pattern, name groups, anchor) ──────────
# ``\z`` is the very end of the text.  Java's run of modifiers and blanks is
# written with a possessive blank run, which matches the same texts.
FUNCTIONS = {
    "python": (r"(?:^|\n)([ \t]*(?:async\s+)?def\s+(\w+)\s*\(.*?\).*?:.*?)(?=\n[ \t]*(?:(?:async\s+)?def\s|class\s)|\z)",
               [2], "def"),
    "javascript": (r"(?:(?:async\s+)?function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function|\(.*?\)\s*=>))",
                   [1, 2], "function|=>"),
    "java": (r"(?:public|private|protected|static|\s++)+[\w<>\[\]]+\s+(\w+)\s*\([^)]*\)\s*(?:throws\s+[\w,\s]+)?\s*\{",
             [1], "{"),
    "go": (r"func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\s*\(", [1], "func"),
    "rust": (r"(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", [1], "fn"),
    "c": (r"(?:static\s+)?(?:inline\s+)?[\w*]+\s+(\w+)\s*\([^)]*\)\s*\{", [1], "{"),
    "cpp": (r"(?:static\s+)?(?:inline\s+)?(?:virtual\s+)?[\w*:]+\s+(\w+)\s*\([^)]*\)\s*(?:const\s*)?(?:override\s*)?\{",
            [1], "{"),
}
FUNCTION_DEFAULT_LANGUAGE = "python"

# ── fixed values: chunking ──────────────────────────────────────────────────
CHUNK_SIZE = 2000
CHUNK_OVERLAP = 200
CHUNK_CHARS_PER_LINE = 50
CHUNK_LOOKBACK = 19
CHUNK_BOUNDARIES = [
    "def ", "class ", "function ", "func ", "fn ", "public ", "private ", "protected ",
    "@app.", "@router.", "module ", "package ",
]

# ── fixed values: manifests ─────────────────────────────────────────────────
MANIFEST_FILES = [  # file name, ecosystem; in scan order
    ("requirements.txt", "PyPI"), ("Pipfile", "PyPI"), ("pyproject.toml", "PyPI"),
    ("package.json", "npm"), ("go.mod", "Go"), ("Cargo.toml", "crates.io"),
    ("Gemfile", "RubyGems"), ("composer.json", "Packagist"),
]
MANIFEST_SKIP_DIRS = ["node_modules", ".git", "__pycache__", "venv", ".venv"]
ECOSYSTEMS = {
    "python": "PyPI", "javascript": "npm", "java": "Maven", "go": "Go",
    "rust": "crates.io", "ruby": "RubyGems", "php": "Packagist",
}

# ── fixed values: name substitution sets of the sample templates ────────────
NAME_SETS = [
    {"var": "data", "func": "process", "param": "user_input", "result": "result"},
    {"var": "value", "func": "handle", "param": "request_data", "result": "output"},
    {"var": "payload", "func": "execute", "param": "raw_input", "result": "response"},
    {"var": "content", "func": "parse", "param": "form_data", "result": "parsed"},
    {"var": "info", "func": "validate", "param": "query_param", "result": "validated"},
]
# ── end of fixed values ─────────────────────────────────────────────────────
