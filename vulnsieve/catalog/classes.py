"""The 11 vulnerability classes: names, CWE and OWASP ids, severity, guidance.

Fixed values, each row with the whole text of its OWASP Top 10 (2021) category.
"""

from __future__ import annotations

# ── fixed values: class id, name, CWE id, CWE name, OWASP, severity ─────────
_CLASS_ROWS = [
    (0, "SQL Injection", "CWE-89",
     "Improper Neutralization of Special Elements used in an SQL Command",
     "A03:2021 — Injection", "critical"),
    (1, "Cross-Site Scripting (XSS)", "CWE-79",
     "Improper Neutralization of Input During Web Page Generation",
     "A03:2021 — Injection", "high"),
    (2, "Command Injection", "CWE-78",
     "Improper Neutralization of Special Elements used in an OS Command",
     "A03:2021 — Injection", "critical"),
    (3, "Path Traversal", "CWE-22",
     "Improper Limitation of a Pathname to a Restricted Directory",
     "A01:2021 — Broken Access Control", "high"),
    (4, "Hardcoded Credentials", "CWE-798",
     "Use of Hard-coded Credentials",
     "A07:2021 — Identification and Authentication Failures", "high"),
    (5, "Insecure Deserialization", "CWE-502",
     "Deserialization of Untrusted Data",
     "A08:2021 — Software and Data Integrity Failures", "critical"),
    (6, "Weak Cryptography", "CWE-327",
     "Use of a Broken or Risky Cryptographic Algorithm",
     "A02:2021 — Cryptographic Failures", "medium"),
    (7, "Buffer Overflow", "CWE-120",
     "Buffer Copy without Checking Size of Input",
     "A06:2021 — Vulnerable and Outdated Components", "critical"),
    (8, "Server-Side Request Forgery (SSRF)", "CWE-918",
     "Server-Side Request Forgery",
     "A10:2021 — Server-Side Request Forgery", "high"),
    (9, "Sensitive Data Exposure", "CWE-200",
     "Exposure of Sensitive Information to an Unauthorized Actor",
     "A02:2021 — Cryptographic Failures", "high"),
    (10, "Insecure Randomness", "CWE-330",
     "Use of Insufficiently Random Values",
     "A02:2021 — Cryptographic Failures", "medium"),
]

# ── fixed values: remediation steps per class, in order of advice ───────────
_REMEDIATION = {
    0: ["Use parameterized queries (prepared statements) for all database access",
        "Use an ORM (Object-Relational Mapping) framework",
        "Implement input validation with allow-lists",
        "Apply the principle of least privilege to database accounts",
        "Escape special characters if parameterized queries are not available"],
    1: ["Encode output data when rendering in HTML context",
        "Use Content-Security-Policy (CSP) headers",
        "Use auto-escaping template engines",
        "Sanitize HTML input with a proven library (e.g., DOMPurify, Bleach)",
        "Avoid innerHTML; use textContent or createElement"],
    2: ["Avoid system shell calls when possible; use language-native APIs",
        "Use argument arrays instead of shell string concatenation",
        "Never use shell=True with user-controlled input",
        "Validate and sanitize input using allow-lists",
        "Implement sandboxing and least-privilege execution"],
    3: ["Validate and canonicalize file paths before use",
        "Use a chroot jail or container to limit filesystem access",
        "Implement path prefix validation (ensure resolved path starts with base)",
        "Use allow-lists for permitted file names",
        "Never use raw user input in file paths"],
    4: ["Use environment variables for all secrets",
        "Implement a secrets management system (Vault, AWS Secrets Manager)",
        "Use configuration files excluded from version control (.gitignore)",
        "Rotate credentials regularly",
        "Use pre-commit hooks to detect secrets before committing"],
    5: ["Never deserialize data from untrusted sources with native serializers",
        "Use JSON or other safe serialization formats",
        "Implement integrity checks (signatures, HMAC) on serialized data",
        "Use allow-lists for deserialization classes",
        "Run deserialization in low-privilege environments"],
    6: ["Use modern algorithms: AES-256-GCM, ChaCha20-Poly1305",
        "Use bcrypt/scrypt/Argon2 for password hashing",
        "Use TLS 1.2+ for data in transit",
        "Generate unique IVs/nonces for each encryption operation",
        "Follow NIST guidelines for key lengths and algorithms"],
    7: ["Use bounded string functions (strncpy, snprintf, fgets)",
        "Enable compiler protections (ASLR, stack canaries, DEP/NX)",
        "Use memory-safe languages (Rust, Go, Java) where possible",
        "Validate all buffer sizes before copy operations",
        "Use static analysis tools to detect buffer issues"],
    8: ["Validate and sanitize all user-supplied URLs",
        "Implement URL allow-lists for permitted domains",
        "Block requests to private IP ranges (10.x, 172.16.x, 192.168.x, 169.254.x)",
        "Disable unnecessary URL schemes (file://, gopher://, dict://)",
        "Use a proxy for outbound requests with egress filtering"],
    9: ["Minimize data exposure — only return necessary fields in APIs",
        "Implement proper access controls on sensitive endpoints",
        "Use generic error messages; never expose stack traces or internals",
        "Encrypt sensitive data at rest and in transit",
        "Implement proper logging without recording sensitive data"],
    10: ["Use cryptographically secure RNG (secrets, crypto.randomBytes, SecureRandom)",
         "Never use Math.random() or random module for security tokens",
         "Ensure sufficient entropy in generated values (minimum 128 bits)",
         "Use secure token generation libraries",
         "Test randomness quality of generated values"],
}

# Description and impact are prose for readers; they decide no result and are
# worded here by us.
_PROSE = {
    0: ("Untrusted data becomes part of a database command and changes its meaning.",
        "Reading, changing or destroying data; bypassing authentication."),
    1: ("Untrusted data reaches a web page unescaped and runs as script in a browser.",
        "Stolen sessions and cookies, defacement, malware delivery."),
    2: ("Untrusted data reaches a system shell and runs as a command.",
        "Arbitrary commands on the host, data loss, lateral movement."),
    3: ("A path built from untrusted data leaves the directory it should stay in.",
        "Disclosure of files, sources, configuration and credentials."),
    4: ("Credentials stand in the source and travel with every copy of it.",
        "Unauthorised access with valid credentials."),
    5: ("Untrusted bytes are turned into objects by a serializer that can run code.",
        "Remote code execution, denial of service, object tampering."),
    6: ("A broken or misused algorithm protects data that needs protection.",
        "Disclosure of data, cracked credentials, failed compliance."),
    7: ("Data is written past the end of a buffer.",
        "Remote code execution, crashes, corrupted memory."),
    8: ("The server fetches an address that untrusted data decides.",
        "Access to internal services and cloud metadata, data exfiltration."),
    9: ("Sensitive information reaches logs, responses or clients that should not see it.",
        "Data breaches, identity theft, regulatory penalties."),
    10: ("Predictable random numbers stand where unguessable ones are needed.",
         "Guessable sessions, tokens and reset codes."),
}
# ── end of fixed values ─────────────────────────────────────────────────────

SEVERITY_ORDER = ("critical", "high", "medium", "low")
NUM_CLASSES = len(_CLASS_ROWS)

CLASS_ROWS = [
    (cid, name, cwe, cwe_name, owasp, severity, *_PROSE[cid], _REMEDIATION[cid])
    for cid, name, cwe, cwe_name, owasp, severity in _CLASS_ROWS
]
CLASS_NAMES = {row[0]: row[1] for row in CLASS_ROWS}
