"""The code corpus that the registered queries scan, derived from the ``documents`` table.

Every document becomes one file: its whole text, followed by a piece of code chosen by its id,
under a path that depends on the id as well.  ``corpus_sql`` is the same for DuckDB.
"""

from __future__ import annotations

from flawsieve.sources.files import spread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# `{id}` stands for the id of the document.
SNIPPETS = (
    'API_KEY = "k{id}abcdef0123456789"\nSALT = "c2FsdHNhbHQ="\npassword = "pw{id}"',
    'cursor.execute("select 1 where a = " + v{id})\nrows = cur.fetchall(q + x)',
    'def run(c):\n    subprocess.run(c, shell=True)\n    return eval(c) + eval (c)',
    'obj = pickle.loads(b)\nh = hashlib.md5(b); g = hashlib.sha1(b)\nd = yaml.load(f)',
    'r = requests.get(\n    url{id})\napp.run(debug=True)\nDEBUG = True',
    'def add(a, b): return a',
    'os.system(cmd)\nos.popen(cmd)\nx = getattr(o, name)\nm = __import__ ("os")',
    'render_template_string("<p>%s</p>" % name)\nnode.innerHTML = t\ndocument.write(t)',
    'full = base + name + path\nf = open(root + name)\nsend_file(p)\nreadfile($p)',
    's.verify = False\nctx = ssl._create_unverified_context()\ncontext = None',
    'user = request.args.get("user_id")\np = get_by_id({id})\nq = "WHERE id = u"',
    'token = random.randint(0, 9)\nt = int(time.time())\nalgorithm = "none"',
    'secret = "s{id}-long-enough"; token = "t{id}-long-enough"\nJWT_SECRET = "j{id}"',
    'redirect($url)\nheader("Location: " . $u)\nset_cookie(a + b)\nmt_rand()',
    'fwrite($f, $line)\nlogging(f, $_GET)\nfile_put_contents($f, $_POST)\nTemplate($t)',
    'move_uploaded_file($a)\nf.save($b)\nphpinfo()\ntraceback.format_exc()',
    'password = os.environ.get("PW")\nbcrypt.hashpw(p)\ncur.execute("a = ?", (x,))',
    'exec(code)\ncompile(src)\nmarshal.load(f)\nunserialize(d)\ncommands.getoutput(c)',
    'user password = x; api_key auth token = y\nadmin login session = z\nurl host port = h',
    'urllib.request.urlopen(u)\nDES(k); RC4(k)\nfile_get_contents($_GET)\n# eval(old)',
)
FOLDERS = ("node_modules/lib_{id}.js", "docs/note_{id}.md", "web/view_{id}.js",
           "src/app/mod_{id}.py", "src/core/mod_{id}.py", "src/mod_{id}.py",
           "tests/test_{id}.py", "web/api/route_{id}.ts")


def _pick(options: tuple[str, ...], key: Column) -> Column:
    chosen = F.get(F.lit(list(options)), F.pmod(key, F.lit(len(options))))
    return F.replace(chosen, F.lit("{id}"), key.cast("string"))


def path_of(key: Column) -> Column:
    return _pick(FOLDERS, key)


def table(spark: SparkSession, sf_dir: str, name: str, *key: str) -> DataFrame:
    """A given table; with a key, spread by it, whatever its size."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows, *key) if key else rows


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, path, content)``."""
    documents = table(spark, sf_dir, "documents", "doc_id")
    key = F.col("doc_id")
    return documents.select(
        "doc_id", "lang", path_of(key).alias("path"),
        F.concat("text", F.lit("\n"), _pick(SNIPPETS, key), F.lit("\n")).alias("content"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pick_sql(options, key) -> str:
    listed = ", ".join(quoted(o) for o in options)
    return f"replace([{listed}][{key} % {len(options)} + 1], '{{id}}', CAST({key} AS VARCHAR))"


def path_sql(key: str) -> str:
    return _pick_sql(FOLDERS, key)


def corpus_sql() -> str:
    return (f"SELECT doc_id, lang, {path_sql('doc_id')} AS path, text || chr(10) || "
            f"{_pick_sql(SNIPPETS, 'doc_id')} || chr(10) AS content FROM documents")
