"""Short code samples mixed into the change corpus derived from the test tables.

Each entry is a positive and a negative sample for one rule or context check;
the text is our own.  Secrets are built by repetition so none is written out.
"""

_FILL = ["    step = step + 1"]

RULE_SAMPLES = [
    ("x = eval(s)", "x = evaluate (s)"),
    ("exec(code)", "execute_all()"),
    ("d = pickle.load(f)", "d = json.load(f)"),
    ('os.system("ls")', "os.systemic = 1"),
    ("# FIXME later", "# done"),
    ("x = eval (s)", "x = evaluate"),
    ("exec (code)", "executed = 1"),
    ("pickle.loads(b)", "pickle.dumps(b)"),
    ("subprocess.call(c, shell=True)", "subprocess.call(c)"),
    ("os.system(c)", "os.path(c)"),
    ("hashlib.md5(b)", "hashlib.sha256(b)"),
    ("hashlib.sha1(b)", "hashlib.sha512(b)"),
    ("random.randint(1, 2)", "secrets.token_hex(8)"),
    ("assert x > 0", "asserted = 1"),
    ("open(p, 'w')", "open(p, 'r')"),
    ("eval (s)", "evalution"),
    ("el.innerHTML = v", "el.textContent = v"),
    ("document.write(v)", "document.title = v"),
    ("setTimeout('go()', 5)", "setTimeout(go, 5)"),
    ("<p dangerouslySetInnerHTML={x}/>", "<p>{x}</p>"),
    ("Math.random()", "Math.floor(x)"),
    ('q = f"SELECT a FROM t WHERE id = {i}"', 'q = "SELECT a FROM t"'),
    ('q = "SELECT a FROM t WHERE id = " + i', 'q = "SELECT a FROM t"'),
    ("q = s % a FROM t", "q = s FROM t"),
    ("is_admin = True", "is_admin = False"),
    ("role = 'admin'", "role = 'viewer'"),
    ("Doc.objects.all().filter(user=u)", "Doc.objects.all()"),
    ("u = request.user or None", "u = request.user"),
    ('c = Cipher("DES")', 'c = Cipher("AES")'),
    ("key = 'abc123'", "key = load_key()"),
    ("get(u, verify=False)", "get(u, verify=True)"),
    ('u = "http://svc.example.com"', 'u = "http://localhost:80"'),
    ('cursor.execute("q %s" % a)', 'cursor.execute("q")'),
    ('M.objects.raw("q" + a)', 'M.objects.raw("q")'),
    ("run(c, shell=True)", "run(c, shell=False)"),
    ("# TODO review security", "# TODO rename"),
    ("DEBUG = True", "DEBUG = False"),
    ("SECRET_KEY = 'abc'", 'SECRET_KEY = env("K")'),
    ("ALLOWED_HOSTS = ['*']", "ALLOWED_HOSTS = hosts"),
    ("CORS_ORIGIN_ALLOW_ALL = True", "CORS_ORIGIN_ALLOW_ALL = False"),
    ("if password == 'hunter22':", "if password == other:"),
    ("token = 'abcdefghij12'", "token = make()"),
    ("remember_me lifetime days 365", "remember_me lifetime days 7"),
    ("pickle.load(f)", "json.load(f)"),
    ("yaml.load(f)", "yaml.load(f, Loader=S)"),
    ("marshal.loads(b)", "marshal.dumps(b)"),
    ("except Exception: pass", "except Exception: raise"),
    ("except Exception:\n    pass", "except Exception:\n    raise"),
    ("requests.get(url)", 'requests.get("/x")'),
    ("urllib.request.urlopen(url)", "urllib.request.Request()"),
    ('api_key = "' + "a" * 24 + '"', 'api_key = "short"'),
    ('secret_key: "' + "b" * 24 + '"', "secret_key: load()"),
    ('password = "longenough1"', 'password = "short"'),
    ('token = "' + "c" * 24 + '"', "token = make()"),
    ("k = sk-" + "d" * 48, "k = sk-" + "d" * 10),
    ("k = sk-ant-api" + "e" * 40, "k = sk-ant-api"),
    ("k = ghp_" + "f" * 36, "k = ghp_" + "f" * 9),
    ("aws_access_key_id = " + "A" * 20, "aws_access_key_id = env()"),
    ("aws_secret_access_key = " + "g" * 40, "aws_secret_access_key = env()"),
    ("-----BEGIN RSA " + "PRIVATE" + " KEY-----", "-----BEGIN CERTIFICATE-----"),
    ('DATABASE_URL = "postgres://u:p@h/d"', "DATABASE_URL = env()"),
    ("jdbc:mysql://u:p@h/d", "jdbc:mysql://h/d"),
    ("if user.is_authenticated == True:", "if user.is_authenticated:"),
    ("@app.route('/x', methods=['PUT'])\ndef put():", "@app.route('/x', methods=['PUT'])\n@login_required"),
    ('jwt.decode(t, algorithms=["none"])', 'jwt.decode(t, ["HS256"])'),
    ("jwt.decode(t, verify=False)", "jwt.decode(t, verify=True)"),
    ("verify(password, plain)", "verify(hash)"),
    ("session['x'] = True  # admin", "session['x'] = False"),
    ("@require_admin @require_login", "@require_login"),
    ('execute(f"SELECT a")', 'execute("SELECT a")'),
    ('os.system("ls " + p)', 'os.system("ls")'),
    ("ldap.search(base + q)", "ldap.bind(u)"),
    ("xpath(e + q)", "xpath(e)"),
    ("render_template_string(request.args)", "render_template(name)"),
    ('collection.find({"a": request.json})', 'collection.find({"a": 1})'),
    ('open(request.args["f"])', "open(path)"),
    ("TripleDES(k)", "AES(k)"),
    ("ARC4(k)", "ChaCha20(k)"),
    ("AES.new(k, AES.MODE_ECB)", "AES.new(k, AES.MODE_GCM)"),
    ("random.choice(xs)", "secrets.choice(xs)"),
    ('iv = b"00000000"', "iv = os.urandom(16)"),
    ("key_size = 512,", "key_size = 2048"),
    ("if True:", "if ready:"),
    ("skip_auth = True", "skip_auth = False"),
    ("is_staff = True  # hardcoded", "is_staff = False"),
    ("def login(u):", "def render(u):"),
    ("drop table users", "create table users"),
    ("created_at = datetime.now()", "created_at = None"),
    ("store this forever", "store this"),
    ("SELECT * FROM users", "SELECT id FROM orders"),
]

CONTEXT_SAMPLES = [
    ("logger.info(email)", "logger.info(total)"),
    ("print(ip_address)", "send(email)"),
    ("save_email(v)", "save_email(encrypt(v))"),
    ("run(user_data)", "run(user_data, consent)"),
    ("requests.post(u, json=user)", "requests.get(u)"),
    ("\n".join(["def delete(x):"] + _FILL * 10), "\n".join(["def delete(x):"] + _FILL * 9 + ["    logger.info(x)"])),
    ("\n".join(["def refund(x):"] + _FILL * 15), "\n".join(["def refund(x):"] + _FILL * 14 + ["    audit(x)"])),
    ("\n".join(["class Ledger(Base):", "    def transfer(self, a):"] + _FILL * 16), "def helper(a):\n    return a"),
    ("function renderAll(a) {", "const loadAll = async (x) => {"),
    ("func (s *Srv) Handle(w int) {", "type Server struct {"),
    ("public static void main(String a) {", "interface Shape {"),
    ('token = "' + "x" * 24 + '"', 'password = "changeme1"'),
    ("++ starts with plus signs", "-- starts with dashes"),
]

SAMPLES = RULE_SAMPLES + CONTEXT_SAMPLES
