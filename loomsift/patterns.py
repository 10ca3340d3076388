"""Every pattern, word list and limit the results depend on.

They are kept in one place because three regex engines read them (Java inside
Spark, RE2 inside the SQL check, Python inside the tests).
"""

# --- Fixed values: limits ----------------------------------------------------
CHARS_PER_TOKEN = 4
MAX_LINES = 60
MAX_LINE_CHARS = 500
SMART_DEDUP_MIN_TOTAL = 4
LOG_LINES = 50
TABLE_LINES = 45
RESPONSE_LINES = 40
SHORT_LINES = 30
FALLBACK_LINES = 25
BUILD_ERROR_LINES = 20
JSON_LINES = 80
BUDGET_LADDER = (40, 25, 15, 8, 4)
CACHE_TTL_SECONDS = 1800
CACHE_DIFF_LINES = 12
BINARY_SAMPLE_CHARS = 4000
BINARY_CONTROL_SHARE = 0.05
JSON_STRING_CHARS = 60
JSON_LEVELS = 6000
NULL_FLAG_SHARE = 0.25
HITS_PER_FILE = 5
LINT_HITS_PER_FILE = 6
LINT_FILES = 40
DIFF_LINES_PER_FILE = 40
ATTRS_SHOWN = 6
SIGNATURES_PER_FILE = 10

# --- Fixed values: patterns --------------------------------------------------
ANSI = r"\x1b\[[0-9;?]*[ -/]*[@-~]"
# What a later carriage return of the line overwrites.
REDRAWN = r"(?md)^[^\n]*\r"
BOMS = ("\ufeff", "\xef\xbb\xbf")
WHITESPACE = " \t\r\n\x0b\x0c"

SECRET_KEY = (
    r"(?i)(secret|password|passwd|token|apikey|api[_-]?key|access[_-]?key|"
    r"accesskeyid|credential|private|policydocument|sessiontoken|"
    r"authorization|connectionstring)")

# A member with such a key in a text that looks like JSON and does not parse.
SECRET_MEMBER = r'("[^"\n]*' + SECRET_KEY.replace("(?i)(", "(?i:").rstrip() + r'[^"\n]*"\s*:\s*)("[^"\\]*+(?:\\.[^"\\]*+)*+"?|[^,}\]\s]+)'

SECRET_ASSIGN = (
    r"(?i)([A-Za-z0-9_.-]*(?:secret|password|passwd|pwd|token|apikey|"
    r"api[_-]?key|access[_-]?key|accountkey|sharedaccesskey|sessiontoken|"
    r"credential|authorization|bearer)[A-Za-z0-9_.-]*)(\s*[:=]\s*)"
    r"(\"[^\"]*\"|'[^']*'|\S+)")
SECRET_TOKEN = (
    r"\b(AKIA[0-9A-Z]{16}"
    r"|ghp_[A-Za-z0-9]{36}"
    r"|github_pat_[A-Za-z0-9_]{22,}"
    r"|xox[baprs]-[A-Za-z0-9-]{10,}"
    r"|sk-[A-Za-z0-9_-]{20,}"
    r"|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,})")
# `Authorization: Bearer xyz` keeps xyz under SECRET_ASSIGN alone.
BEARER_VALUE = r"(?i)\b(bearer\s+)(?!<redacted>)[A-Za-z0-9._~+/=-]+"
MASK = "<redacted>"

PROGRESS_PERCENT = r"^[\.\#=>\-\s]*\d+%"
PROGRESS_VERB = (
    r"^(Downloading|Fetching|Receiving|Resolving|Unpacking|"
    r"Delta compression|Compressing|Writing objects|"
    r"Counting objects|Enumerating objects)\b")

TIMESTAMP_PREFIX = (
    r"^[\[\(]?(?:"
    r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
    r"|\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?"
    r"|\d{2}/\w{3}/\d{4}[: ]\d{2}:\d{2}:\d{2}"
    r"|\d{2}:\d{2}:\d{2}(?:[.,]\d+)?"
    r")[\]\)]?[: ]*")

ERROR_LINE = (
    r"(?i)\b(error|errors|failed|failure|fail|fatal|panic|exception|traceback|"
    r"assert|assertion|denied|refused|cannot|unable|invalid|not found|"
    r"unresolved|conflict|E\d{2,})\b|✗|✖|×")

CONTROL_CHARS = r"[\x00-\x08\x0e-\x1f]"
BASE64_RUN = r"[A-Za-z0-9+/=]{400,}"
BLOB_NOTE = "[base64-like content suppressed]"

HTML_DROP_ELEMENT = r"(?is)<(script|style|svg|head|noscript)[^>]*>.*?</\1>"
HTML_COMMENT = r"(?s)<!--.*?-->"
HTML_LINE_END = r"(?i)<br\s*/?>|</(p|div|h[1-6]|li|tr|section|article)>"
HTML_TAG = r"(?s)<[^>]+>"
HTML_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
                 ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))
HTML_PAGE = r"(?i)<!doctype html|<html[\s>]"

SIGNATURE_LINE = (
    r"^\s*(def |class |async def |function |func |public |private |protected |"
    r"import |from |export |type |interface |struct |impl |trait |module |"
    r"@|#\s*(TODO|FIXME))")
CODE_EXTENSIONS = ("py", "js", "ts", "tsx", "jsx", "go", "rs", "java", "rb",
                   "c", "h", "cpp", "cc", "cs", "php", "kt", "swift", "scala")

LIBRARY_FRAME = (
    r"site-packages|dist-packages|node_modules|[/\\]lib[/\\]python\d|"
    r"[/\\]vendor[/\\]|[/\\]gems[/\\]")
EXCEPTION_LINE = r"^[A-Za-z_.]+(Error|Exception|Warning)\b"
FRAME_AT = r"(?m)^\s+at .+\("
FRAME_FILE = r"(?m)^\s+File \".+\", line \d+"

EPOCH_MARK = r"(?i)\bEpoch\s+(\d+)\s*/\s*(\d+)"
EPOCH_LINE = r"(?im)^\s*epoch[\s:=]"
METRIC = r"([A-Za-z_][A-Za-z0-9_]*)\s*[:=]\s*([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)"
# The matches of METRIC: a name begins where no letter stands before it (the leftmost
# match begins there anyway) and nothing is tried twice.
METRIC_ONCE = r"(?<![A-Za-z_])[A-Za-z_][A-Za-z0-9_]*+\s*+[:=]\s*+[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
METRIC_SKIP = ("epoch", "eta", "step", "steps", "batch", "lr")
METRIC_ORDER = ("loss", "val_loss", "accuracy", "acc", "val_accuracy", "val_acc")
METRICS_SHOWN = 4
BEST_METRIC_ORDER = (("val_loss", "min"), ("val_accuracy", "max"),
                     ("val_acc", "max"), ("accuracy", "max"), ("acc", "max"),
                     ("loss", "min"))

DESCRIBE_FIELD = r"^\s{0,2}[A-Z][A-Za-z0-9 /_.-]*:"
STATUS_FIELD = (
    r"^(●|\*|Loaded:|Active:|Main PID:|Tasks:|Memory:|"
    r"CGroup:|[A-Za-z0-9_.@-]+\.(service|socket|timer))")
PLAN_LINE = r"^#\s|^[+~\-/]{1,2}\s*resource"
PLAN_WORDS = ("Plan:", "Apply complete", "No changes", "will be")
SEPARATOR_ROW = r"^[\s\-|+=]+$"
CELL_GAP = r"\s{2,}"
HEALTHY_STATUS = ("Running", "Completed", "Succeeded")

HUNK_RANGE = r"^(@@ [^@]*@@)"
HUNK_LINE = r"(?m)^@@ .*@@"

GREP_HIT = r"^([^:]+):(\d+):(.*)$"
LINT_HIT = r"^(.*?)[\(:](\d+)[,:](\d+)\)?:?\s*(.*)$"
LINT_HIT_NO_COLUMN = r"^([^\s:]+):(\d+): (.*)$"

TEST_SECTION = r"^=+\s*(.*?)\s*=+$"
TEST_BLOCK = r"^_{3,}\s*(.+?)\s*_{3,}$"
TEST_LOCATION = r"^\S+:\d+:"
TEST_PASSED = r"=+\s*([^=\n]*passed[^=\n]*?)\s*=+"
TEST_SUMMARY = (
    r"(?i)(\d+\s+passed[^\n]*|\d+\s+tests?\s+passed[^\n]*|"
    r"ok\b[^\n]*|test result:\s*ok[^\n]*|PASS[^\n]*|"
    r"Tests:.*passed[^\n]*)")
BUILD_OK = r"(BUILD SUCCESS(?:FUL)?[^\n]*)"
BUILD_TIME = r"Total time:\s*([^\n]+)"
INSTALL_OK = r"(?i)((?:added|installed|Successfully installed)[^\n]*)"
PULL_SUMMARY = r"(\d+ files? changed[^\n]*)"

SKIP_DIRS = (".git", "node_modules", ".venv", "venv", "__pycache__",
             "dist", "build", ".mypy_cache", ".terraform", ".idea")

COST_GROUP_COLUMNS = ("resourcegroup", "resourcegroupname", "businessunit")

# Words that must occur (in any case) for SECRET_ASSIGN, SECRET_TOKEN or
# BEARER_VALUE to be able to match; a byte search for them is much cheaper than
# the patterns.
SECRET_HINTS = ("secret", "passw", "pwd", "token", "key", "credential",
                "authorization", "bearer", "akia", "ghp_", "github_pat_",
                "xox", "sk-", "eyj")

# The same for ERROR_LINE.
ERROR_HINTS = ("error", "fail", "fatal", "panic", "exception", "traceback",
               "assert", "denied", "refused", "cannot", "unable", "invalid",
               "not found", "unresolved", "conflict", "✗", "✖", "×")
ERROR_CODE_HINT = r"[Ee]\d\d"

#: A row of a printed classification report: a label, three scores and a count.
REPORT_ROW = r"(?m)^\s*\S.*?\s+[01]\.\d+\s+[01]\.\d+\s+[01]\.\d+\s+\d+\s*$"
