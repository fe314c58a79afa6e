"""Fixed values.

These settings, word lists and patterns decide results, so they are stated
here as they are and nowhere else.  Every function takes them as defaults.
"""

# Retrieval
TOP_K = 6
DEDUP_PREFIX = 100
MAX_EXPANSIONS = 2

# Chunking
CHUNK_SIZE = 800
CHUNK_OVERLAP = 120
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ": ", ", ", " ", "")
CHUNK_ID_HASH_CHARS = 12

# Files
ALLOWED_TYPES = ("txt", "pdf", "png", "jpg", "jpeg", "webp", "gif")
MAX_UPLOAD_MB = 50

# Answer cache
CACHE_THRESHOLD = 0.92
CACHE_TTL_SECONDS = 7 * 24 * 3600
CACHE_ENTRIES = 500

# Conversations
MESSAGES_KEPT = 40
HISTORY_TURNS = 5
CONVERSATIONS_KEPT = 200
CONVERSATIONS_LISTED = 50
SIDEBAR_KEPT = 20
TITLE_CHARS = 40
SUMMARY_CHARS = 36
DEFAULT_TITLE = "New chat"

# Accounts and sessions
ACCOUNT_ID_PATTERN = "^[a-z0-9@._-]{3,80}$"
SESSION_TTL_SECONDS = 7 * 24 * 3600

# Web pages
CONTENT_SELECTORS = ("main", "article", "#app", "#content", ".content", "body")
MIN_RAW_CHARS = 300
MIN_CLEAN_CHARS = 200
MIN_LINE_CHARS = 2
MAX_PAGES = 80
SKIP_EXTENSIONS = (
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip", ".rar",
    ".jpg", ".jpeg", ".png", ".gif",
)
SKIP_WORDS = ("login", "register", "wp-admin", "wp-login")

# Answer streams
THINK_OPEN = "__THINK__"
THINK_CLOSE = "__ENDTHINK__"

# Intent rules, first match wins
INTENT_RULES = (
    ("Searching Malaysian public holidays",
     ("holiday", "假期", "public holiday", "节假日", "deepavali", "hari raya",
      "christmas", "new year", "chinese new year")),
    ("Searching academic calendar",
     ("calendar", "日历", "semester", "学期", "schedule", "安排")),
    ("Searching course timetables",
     ("timetable", "时间表", "course", "课程", "class", "课程表")),
    ("Searching advisor information",
     ("advisor", "导师", "supervisor", "professor", "教授", "staff", "教师")),
    ("Searching admission requirements",
     ("admission", "入学", "apply", "申请", "requirement", "要求", "program", "专业")),
    ("Searching visa information",
     ("visa", "签证", "renew", "续签", "pass", "准证")),
    ("Searching campus facilities",
     ("facility", "设施", "library", "图书馆", "lab", "实验室", "service", "服务")),
    ("Searching contact information",
     ("contact", "联系", "phone", "电话", "email", "邮箱", "office", "办公室")),
    ("Searching registration info",
     ("register", "注册", "enroll", "enrolment", "报名")),
)
INTENT_DEFAULT = "Analyzing question"
