"""Our own code snippets: labelled template pairs and one probe line per rule.

``TEMPLATES`` are pairs of a weak and a sound way to write the same thing, per
vulnerability class; ``{var} {func} {param} {result}`` are replaced by one of the
name sets.  ``PROBES`` holds, per rule, a line the rule must report.  Secrets below
are made up and unusable.
"""

from __future__ import annotations

from vulnsieve.catalog.patterns import EXTENSION_LANGUAGE, NAME_SETS
from vulnsieve.catalog.rules import RULES

# class -> [(language, weak, sound, why weak, why sound)]
TEMPLATES: dict[int, list[tuple[str, str, str, str, str]]] = {
    0: [
        ("python", "def {func}({param}):\n    {var} = \"SELECT id FROM orders WHERE ref = '\" + {param} + \"'\"\n    cursor.execute({var})\n    return cursor.fetchall()",
         "def {func}({param}):\n    cursor.execute(\"SELECT id FROM orders WHERE ref = %s\", ({param},))\n    return cursor.fetchall()",
         "Query text joined from input", "Bound parameter"),
        ("python", "def {func}({param}):\n    {var} = f\"DELETE FROM carts WHERE owner = {{{param}}}\"\n    return conn.run({var})",
         "def {func}({param}):\n    return conn.run(\"DELETE FROM carts WHERE owner = :o\", o={param})",
         "Query text is an f-string", "Named parameter"),
        ("javascript", "function {func}(req, res) {\n  db.query(`SELECT * FROM items WHERE tag = ${req.query.tag}`, (e, {result}) => res.json({result}));\n}",
         "function {func}(req, res) {\n  db.query('SELECT * FROM items WHERE tag = ?', [req.query.tag], (e, {result}) => res.json({result}));\n}",
         "Template literal in a query", "Placeholder"),
        ("java", "public List<Row> {func}(String {param}) {\n    Statement st = conn.createStatement(); return st.executeQuery(\"SELECT * FROM t WHERE a = '\" + {param} + \"'\");\n}",
         "public List<Row> {func}(String {param}) {\n    PreparedStatement st = conn.prepareStatement(\"SELECT * FROM t WHERE a = ?\");\n    st.setString(1, {param});\n    return read(st.executeQuery());\n}",
         "Statement built by joining", "Prepared statement"),
        ("php", "<?php\nfunction {func}($db, ${param}) {\n    return mysqli_query($db, \"SELECT * FROM news WHERE slug = '${param}'\");\n}",
         "<?php\nfunction {func}($db, ${param}) {\n    $s = $db->prepare('SELECT * FROM news WHERE slug = ?');\n    $s->bind_param('s', ${param});\n    return $s->execute();\n}",
         "Variable inside the query text", "Bound parameter"),
        ("go", "package store\n\nfunc {func}(db *sql.DB, {param} string) (*sql.Rows, error) {\n\tq := fmt.Sprintf(\"SELECT * FROM log WHERE who = '%s'\", {param})\n\treturn db.Query(q)\n}",
         "package store\n\nfunc {func}(db *sql.DB, {param} string) (*sql.Rows, error) {\n\treturn db.Query(\"SELECT * FROM log WHERE who = $1\", {param})\n}",
         "Query formatted from input", "Numbered parameter"),
        ("ruby", "def {func}({param})\n  Post.where(\"title = '#{{param}}'\")\nend",
         "def {func}({param})\n  Post.where(title: {param})\nend",
         "Interpolation in a condition", "Hash condition"),
    ],
    1: [
        ("javascript", "function {func}({param}) {\n  document.getElementById('out').innerHTML = {param};\n}",
         "function {func}({param}) {\n  document.getElementById('out').textContent = {param};\n}",
         "Markup from input", "Plain text node"),
        ("javascript", "const express = require('express');\nconst app = express();\napp.get('/hi', (req, res) => {\n  res.send('<p>' + req.query.name + '</p>');\n});",
         "const express = require('express');\nconst app = express();\napp.use(helmet());\napp.use(cors());\napp.use(rateLimit());\napp.get('/hi', (req, res) => {\n  res.json({ name: req.query.name });\n});",
         "Input echoed as HTML", "JSON answer"),
        ("php", "<?php\necho \"Welcome \" . $_GET['name'];\n",
         "<?php\n$name = filter_input(INPUT_GET, 'name');\nprint(htmlspecialchars($name));\n",
         "Superglobal echoed", "Escaped output"),
        ("python", "from flask import Flask, request, render_template_string\napp = Flask(__name__)\n\n@app.route('/admin/{func}')\ndef {func}():\n    return render_template_string(request.args['{param}'])",
         "from flask import Flask, request, render_template\napp = Flask(__name__)\n\n@app.route('/{func}')\ndef {func}():\n    return render_template('{func}.html', value=request.args['{param}'])",
         "Template text from input", "Template file"),
        ("javascript", "import React from 'react';\nexport const View = ({ {param} }) => <div dangerouslySetInnerHTML={{ __html: {param} }} />;",
         "import React from 'react';\nexport const View = ({ {param} }) => <div>{ {param} }</div>;",
         "Raw markup property", "Escaped child"),
    ],
    2: [
        ("python", "import os\n\ndef {func}({param}):\n    os.system(\"nslookup \" + {param})",
         "import subprocess\n\ndef {func}({param}):\n    subprocess.run([\"nslookup\", {param}], check=True)",
         "Shell command from input", "Argument list"),
        ("python", "import subprocess, sys\n\n{var} = sys.argv[1]\n{result} = subprocess.check_output(\"du -sh \" + {var}, shell=True)",
         "import subprocess, sys\nimport logging\n\n{result} = subprocess.check_output([\"du\", \"-sh\", sys.argv[1]])",
         "Shell enabled", "Shell not used"),
        ("javascript", "const { exec } = require('child_process');\nfunction {func}({param}) {\n  exec('tar xf ' + {param});\n}",
         "const { execFile } = require('child_process');\nfunction {func}({param}) {\n  execFile('tar', ['xf', {param}]);\n}",
         "Command joined from input", "Argument array"),
        ("java", "public void {func}(String {param}) throws IOException {\n    Runtime.getRuntime().exec(\"convert \" + {param});\n}",
         "public void {func}(String {param}) throws IOException {\n    new ProcessBuilder(\"convert\", {param}).start();\n}",
         "Runtime command", "Process builder"),
        ("php", "<?php\n$host = $_POST['host'];\n$out = shell_exec(\"ping -c1 $host\");\necho $out;",
         "<?php\n$host = escapeshellarg(filter_input(INPUT_POST, 'host'));\nprint($host);",
         "Shell with input", "Escaped argument"),
    ],
    3: [
        ("python", "def {func}(request):\n    return open(\"/srv/files/\" + request.args[\"{param}\"]).read()",
         "def {func}(name):\n    target = (ROOT / name).resolve()\n    if not target.is_relative_to(ROOT):\n        raise ValueError(name)\n    return target.read_bytes()",
         "Path from the request", "Resolved and checked"),
        ("javascript", "app.get('/dl', (req, res) => {\n  res.sendFile('/srv/' + req.query.file);\n});",
         "app.get('/dl', (req, res) => {\n  res.download(catalogue.lookup(req.query.id));\n});",
         "File named by the request", "Looked up by id"),
        ("php", "<?php\n$page = $_GET['page'];\ninclude($page);\n",
         "<?php\n$pages = ['home' => 'home.php'];\nrequire $pages['home'];\n",
         "Include from input", "Allow-list"),
    ],
    4: [
        ("python", "DB_PASSWORD = \"s3cret-Horse-battery\"\n\ndef {func}():\n    return connect(password=\"s3cret-Horse-battery\")",
         "import os\n\ndef {func}():\n    return connect(password=os.environ[\"DB_PASS\"])",
         "Password in the source", "Password from the environment"),
        ("javascript", "const api_key = \"0123456789abcdef0123\";\nmodule.exports = { api_key };",
         "const apiKey = process.env.API_KEY;\nmodule.exports = { apiKey };",
         "Key in the source", "Key from the environment"),
        ("java", "class {func} {\n    String url = \"postgres://svc:hunter2@db/main\";\n}",
         "class {func} {\n    String url = System.getenv(\"DATABASE_URL\");\n}",
         "Credentials in an address", "Address from the environment"),
    ],
    5: [
        ("python", "import pickle\n\ndef {func}({param}):\n    return pickle.loads({param})",
         "import json\n\ndef {func}({param}):\n    return json.loads({param})",
         "Pickle of untrusted bytes", "JSON"),
        ("python", "import yaml\n\ndef {func}({param}):\n    return yaml.load({param})",
         "import yaml\n\ndef {func}({param}):\n    return yaml.safe_load({param})",
         "Full loader", "Safe loader"),
        ("java", "public Object {func}(InputStream {param}) throws Exception {\n    return new ObjectInputStream({param}).readObject();\n}",
         "public Dto {func}(InputStream {param}) throws Exception {\n    return mapper.readValue({param}, Dto.class);\n}",
         "Native deserialization", "Typed JSON mapping"),
        ("php", "<?php\n${var} = unserialize($_COOKIE['{param}']);\n${result} = unserialize(${var});",
         "<?php\n${var} = json_decode($raw, true);",
         "Unserialize of a cookie", "JSON"),
    ],
    6: [
        ("python", "import hashlib\n\ndef {func}({param}):\n    return hashlib.md5({param}).hexdigest()",
         "import hashlib\n\ndef {func}({param}):\n    return hashlib.sha256({param}).hexdigest()",
         "MD5 digest", "SHA-256 digest"),
        ("javascript", "const c = crypto.createCipher('des', key);\nconst mode = 'ECB mode';",
         "const c = crypto.createCipheriv('aes-256-gcm', key, iv);",
         "Old cipher interface", "Authenticated mode"),
        ("java", "byte[] {func}(byte[] {param}) throws Exception {\n    return Cipher.getInstance(\"DES\").doFinal({param}); // DES.\n}",
         "byte[] {func}(byte[] {param}) throws Exception {\n    return Cipher.getInstance(\"AES/GCM/NoPadding\").doFinal({param});\n}",
         "DES cipher", "AES in GCM mode"),
    ],
    7: [
        ("c", "#include <string.h>\nvoid {func}(const char *{param}) {\n    char buf[16]; strcpy(buf, {param});\n}",
         "#include <string.h>\nvoid {func}(const char *{param}) {\n    char buf[16];\n    strncpy(buf, {param}, 15);\n    buf[15] = 0;\n}",
         "Unbounded copy", "Bounded copy"),
        ("cpp", "#include <iostream>\nint {func}() {\n    char line[32];\n    gets(line);\n    return sprintf(line, \"%s!\", line);\n}",
         "#include <iostream>\nint {func}() {\n    std::string line;\n    std::getline(std::cin, line);\n    return line.size();\n}",
         "Unbounded read", "Growing string"),
        ("c", "#include <stdio.h>\nint main(void) {\n    char w[8];\n    scanf(\"%s\", w);\n    goto done;\ndone:\n    return 0xDEAD;\n}",
         "#include <stdio.h>\nint main(void) {\n    char w[8];\n    return fgets(w, sizeof w, stdin) == 0;\n}",
         "Unbounded scan", "Bounded read"),
    ],
    8: [
        ("python", "import requests\n\ndef {func}(request):\n    return requests.get(request.args[\"{param}\"])",
         "import requests\n\ndef {func}(key):\n    return requests.get(ALLOWED[key], timeout=5)",
         "Address from the request", "Allow-listed address"),
        ("go", "package fetch\n\nfunc {func}({param} string) (*http.Response, error) {\n\treturn http.Get({param})\n}",
         "package fetch\n\nfunc {func}() (*http.Response, error) {\n\treturn http.Get(\"https://api.example.org/v1\")\n}",
         "Dynamic address", "Fixed address"),
    ],
    9: [
        ("python", "import traceback\n\ndef {func}({param}):\n    print(\"password\", {param})\n    return {\"error\": traceback.format_exc(), \"as\": \"json\"}",
         "import logging\n\ndef {func}({param}):\n    logging.exception(\"failed\")\n    return {\"error\": \"internal\"}",
         "Secrets and traces in output", "Generic message"),
        ("javascript", "app.get('/internal/env', (req, res) => {\n  res.json(process.env);\n  console.log(user.ssn);\n});\nif (DEBUG) {\n  app.get('/debug_api', h);\n}",
         "app.get('/health', (req, res) => {\n  res.json({ ok: true });\n});",
         "Environment served", "Health only"),
        ("rust", "fn {func}() {\n    let debug = true;\n    println!(\"token {}\", token);\n}",
         "fn {func}() {\n    let quiet = 1;\n}",
         "Token printed", "Nothing printed"),
    ],
    10: [
        ("python", "import random\n\ndef {func}():\n    return random.randint(0, 10**9)",
         "import secrets\n\ndef {func}():\n    return secrets.token_hex(16)",
         "Predictable generator", "Secure generator"),
        ("javascript", "function {func}() {\n  const session = Math.floor(Math.random() * 1e9); // session id\n  return session;\n}",
         "function {func}() {\n  return crypto.randomBytes(16).toString('hex');\n}",
         "Predictable generator", "Secure generator"),
        ("java", "public int {func}() {\n    return new Random().nextInt();\n}",
         "public int {func}() {\n    return new SecureRandom().nextInt();\n}",
         "Predictable generator", "Secure generator"),
    ],
}

_FAKE = "Zz0" * 12

PROBES: dict[str, str] = {
    "SQL001": "cursor.execute(\"SELECT 1 WHERE a = %s\" % x)",
    "SQL002": "q = \"DELETE FROM t WHERE a = \" + who",
    "SQL003": "q = f\"UPDATE t SET a = {v}\"",
    "SQL004": "q = base % user_id",
    "SQL005": "q = '{}'.format(t); # SELECT",
    "SQL006": "conn.createStatement().execute(q);",
    "SQL007": "$r = mysqli_query($db, \"select '$x'\");",
    "SQL008": "db.exec(`drop ${t}`);",
    "SQL009": "Model.objects.raw(f'select')",
    "SQL010": "q := fmt.Sprintf(\"INSERT INTO t VALUES (%d)\", n)",
    "SQL011": "s = sqlalchemy.text(f'select {x}')",
    "SQL012": "User.where(\"name = '#{name}'\")",
    "XSS001": "el.innerHTML = value;",
    "XSS002": "document.write(value);",
    "XSS003": "<p dangerouslySetInnerHTML={x} />",
    "XSS004": "el.outerHTML = value;",
    "XSS005": "res.send('<b>hi</b>');",
    "XSS006": "echo 'hi ' . $_COOKIE['n'];",
    "XSS007": "html = Markup(value)",
    "XSS008": "render_template_string(t)",
    "XSS009": "<p v-html=\"x\"></p>",
    "XSS010": "response.write(params.body)",
    "XSS011": "jQuery('#a').append(value);",
    "XSS012": "<%= name %>",
    "CMD001": "os.system(cmd)",
    "CMD002": "os.popen(cmd)",
    "CMD003": "subprocess.Popen(cmd, shell=True)",
    "CMD004": "spawn('ls ' + dir);",
    "CMD005": "shell_exec(\"id $u\");",
    "CMD006": "passthru($cmd);",
    "CMD007": "Runtime.getRuntime().exec(cmd);",
    "CMD008": "out = `ls #{dir}`",
    "CMD009": "c := exec.Command(\"bash\", \"-c\", s)",
    "CMD010": "eval(request.body)",
    "CMD011": "exec(\"x = %d\" % n)",
    "CMD012": "std::system(cmd);",
    "PTH001": "data = open(base + request.name)",
    "PTH002": "p = os.path.join(root, request.name)",
    "PTH003": "p = '../etc'",
    "PTH004": "return send_file(request.args['f'])",
    "PTH005": "res.sendFile(dir + req.query.f);",
    "PTH006": "new FileInputStream(dir + name);",
    "PTH007": "file_get_contents($f);",
    "PTH008": "include($f);",
    "CRD001": "password = 'hunter22'",
    "CRD002": "apikey = 'abcdefgh1234'",
    "CRD003": "jwt_secret = 'abcdefgh1234'",
    "CRD004": "k = 'pk_test_" + _FAKE[:24] + "'",
    "CRD005": "k = 'ASIA" + _FAKE[:16] + "'",
    "CRD006": "k = 'ghu_" + _FAKE + "'",
    "CRD007": "token: '" + _FAKE[:24] + "'",
    "CRD008": "-----BEGIN DSA PRIVATE KEY-----",
    "CRD009": "u = 'mongodb+srv://me:pw@host'",
    "CRD010": "u = 'redis://me:pw@host'",
    "CRD011": "MYSQL_PASSWORD = 'x1'",
    "CRD012": "k = 'xoxb-" + _FAKE[:12] + "'",
    "DES001": "o = pickle.Unpickler(f)",
    "DES002": "o = yaml.load(f)",
    "DES003": "o = marshal.load(f)",
    "DES004": "d = shelve.open(p)",
    "DES005": "new ObjectInputStream(in);",
    "DES006": "$o = unserialize($x);",
    "DES007": "const o = JSON.parse(r.body);",
    "DES008": "import xml.dom; xml.dom.minidom.parse(f)",
    "DES009": "new BinaryFormatter().Deserialize(s);",
    "CRP001": "h = md5(x)",
    "CRP002": "h = sha1(x)",
    "CRP003": "c = DES.new(k)",
    "CRP004": "c = Blowfish(k)",
    "CRP005": "mode = 'ECB mode'",
    "CRP006": "crypto.createCipher('rc', k);",
    "CRP007": "key_size = 64",
    "CRP008": "s.encode('rot13')",
    "CRP009": "base64.b64encode(password)",
    "CRP010": "c = crc32(x)",
    "BOF001": "strcpy(a, b);",
    "BOF002": "strcat(a, b);",
    "BOF003": "gets(a);",
    "BOF004": "sprintf(a, f, b);",
    "BOF005": "scanf(\"%s\", a);",
    "BOF006": "p = alloca(n);",
    "BOF007": "memcpy(a, b, strlen(b));",
    "BOF008": "char a[8]; strcpy(a, b);",
    "SSR001": "requests.post(user_input)",
    "SSR002": "urllib.request.urlopen(u)",
    "SSR003": "fetch(req.query.u);",
    "SSR004": "curl_exec($c);",
    "SSR005": "new HttpClient().GetAsync(u);",
    "SSR006": "r, e := http.Post(u, t, b)",
    "EXP001": "return traceback.format_exc().json",
    "EXP002": "DEBUG = True",
    "EXP003": "print('secret', s)",
    "EXP004": "password_hash, response",
    "EXP005": "X-Powered-By: none",
    "EXP006": "Server: nginx",
    "EXP007": "print_all(os.environ, json)",
    "EXP008": "row.tax_id",
    "RNG001": "n = random.choice(xs)",
    "RNG002": "n = Math.random();",
    "RNG003": "Random r = new Random();",
    "RNG004": "srand(time(0));",
    "RNG005": "t = uuid4() # session",
    "RNG006": "n = Math.floor(Math.random() * 9); // token",
    "RNG007": "$n = mt_rand(1, 6);",
    "AUT005": "k = 'AKIA" + _FAKE[:16] + "'",
    "AUT006": "k = 'ya29." + _FAKE[:10] + "'",
    "AUT007": "k = 'gho_" + _FAKE + "'",
    "AUT008": "k = 'sk_live_" + _FAKE[:24] + "'",
    "AUT009": "-----BEGIN PRIVATE KEY-----",
    "AUT010": "slack_token = '" + _FAKE[:20] + "'",
}

LANGUAGE_EXTENSION: dict[str, str] = {}
for _ext, _language in EXTENSION_LANGUAGE.items():
    LANGUAGE_EXTENSION.setdefault(_language, _ext)


def fill_names(code: str, name_set: int) -> str:
    for key, value in NAME_SETS[name_set].items():
        code = code.replace("{" + key + "}", value)
    return code


def template_rows() -> list[tuple]:
    """``(template_id, class_id, pick, language, weak, sound, why weak, why sound)``."""
    rows = []
    for class_id, pairs in TEMPLATES.items():
        for pick, (language, weak, sound, why_weak, why_sound) in enumerate(pairs):
            rows.append((len(rows), class_id, pick, language, weak, sound, why_weak, why_sound))
    return rows


def corpus_snippets() -> list[tuple[int, str, str]]:
    """``(snippet_id, extension, code)``: both halves of every template, then per
    language one file of the probe lines of its rules, then files without a known
    extension or with odd blanks."""
    out: list[tuple[int, str, str]] = []

    def add(extension: str, code: str) -> None:
        out.append((len(out), extension, code))

    for template_id, _, _, language, weak, sound, _, _ in template_rows():
        add(LANGUAGE_EXTENSION[language], fill_names(weak, template_id % len(NAME_SETS)))
        add(LANGUAGE_EXTENSION[language], fill_names(sound, template_id % len(NAME_SETS)))
    for language, extension in LANGUAGE_EXTENSION.items():
        own = [PROBES[r.rule_id] for r in RULES if r.languages and language in r.languages]
        shared = [PROBES[r.rule_id] for r in RULES if r.languages is None]
        add(extension, "\n".join(own + shared))
    add(".txt", "\n".join(PROBES[r.rule_id] for r in RULES))
    add("", "def handler(request):\n    eval(\n        request.body)  \n\n\n\n\nimport logging\n")
    add(".JS", "el.innerHTML\n  = value\nrequire('child_process')\nrequire( \"vm\" )")
    add(".py", "import pickle\nfrom django.conf import settings\nfrom xml.etree import ElementTree\nimport random  # not secure\nimport random as r\n")
    add(".py", "@app.route('/internal/debug')\ndef route():\n    if DEBUG:\n        pass # x: the path\n")
    add(".php", "<?php\nfunction f($a) {\n  extract($_POST);\n  preg_replace('/x/e', $a, $b);\n  include('x');\n}\n")
    add(".java", "@RestController\nclass A {\n  @GetMapping(\"/admin/users\")\n  public String list() throws IOException {\n    return \"x\";\n  }\n}\n")
    return out
