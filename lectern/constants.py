"""Fixed values that decide results: thresholds, labels, patterns, prices.

Everything in this module is a fixed value. Operators take the thresholds as
parameters and only use these as defaults.
"""

# --- segmentation (milliseconds)
CHUNK_MIN_MS = 30_000
CHUNK_MAX_MS = 90_000
CHUNK_GAP_MS = 1_500
CHAPTER_GAP_MS = 6_000
CHAPTER_MAX_MS = 600_000

# --- documents
DOCUMENT_SUFFIXES = (".md", ".txt", ".markdown")
MS_PER_CHAR = 50
MIN_SPAN_MS = 1_000
PARAGRAPH_TARGET_CHARS = 1_200
PARAGRAPH_MAX_CHARS = 2_400
PREFACE_TITLE = "导言"
UNNAMED_DOCUMENT = "未命名文档"

# --- slides
FRAME_CHANGE_RATIO = 0.02
FRAME_MAX_HOLD_MS = 120_000
FRAME_MAX_GROUPS = 400
FRAMES_PER_GROUP_LIMIT = 6
OCR_MIN_SCORE = 0.5
SLIDE_MARK = "【课件】"

# --- audio splitting
SPLIT_MIN_GAP_MS = 30_000
SPLIT_MIN_WINDOW_MS = 5_000
SPLIT_MIN_SPAN_MS = 5_000
SPLIT_OVERLAP_MS = 1_000

# --- retrieval
BM25_K1 = 1.2
BM25_B = 0.75
BM25_MIN_IDF = 1e-6
RRF_K = 60
TOP_K = 8
RERANK_TOP_N = 5
TIME_BIAS_WEIGHT = 0.15
TIME_BIAS_SCALE_MS = 600_000
SEARCH_TOP_K = 20
SEARCH_BUCKET_MS = 2_000
CROSS_PER_COURSE = 5
STAGE_SEGMENT_INDEX = 10.0
STAGE_SEGMENT_LIKE = 8.0
STAGE_CHUNK_INDEX = 5.0
STAGE_CHUNK_LIKE = 6.0
STAGE_SLIDE_LIKE = 4.0
STAGE_CHAPTER_LIKE = 7.0

# --- answers, citations, prompts
MAX_CITATIONS = 12
MAX_EVIDENCE_SLIDES = 3
CITATION_TEXT_CHARS = 400
HISTORY_MESSAGES = 12
HISTORY_CHARS = 800
HINT_SPANS = 5
PREFIX_MAX_CHARS = 200_000
PREFIX_TOKEN_BUDGET = 400_000
CHAPTER_CHAR_BUDGET = 60_000
QUIZ_MATERIAL_CHARS = 14_000
QUIZ_SUMMARY_CHARS = 3000
QUIZ_MIN_CHARS = 80
QUIZ_DEFAULT_COUNT = 8
QUIZ_MIN_COUNT = 3
QUIZ_MAX_COUNT = 20
GUIDE_TOLERANCE_MS = 15_000
TERM_WINDOW_CHARS = 110
TERM_CONTEXT_LIMIT = 8
ELLIPSIS = "…"
NEW_CHAT_TITLE = "新对话"
OCR_LABEL = "（课件）"
CUT_NOTICE = "\n\n（材料过长已截断）"
CHAPTER_CUT_NOTICE = "\n（本章内容过长，已截断）"

# --- evaluation
CITATION_TOLERANCE_MS = 90_000
GATES = (
    ("factual", 0.80),
    ("cross", 0.65),
    ("global", 0.65),
    ("visual", 0.60),
    ("overall", 0.70),
)
WRONG_CITATION_GATE = 0.05
QUESTION_TYPES = (
    ("factual", "f", 90_000),
    ("cross", "c", 300_000),
    ("visual", "v", 120_000),
    ("global", "g", 600_000),
)

# --- question intent
VISUAL_HINTS = ("这张图", "画面", "板书", "ppt", "幻灯", "图里", "图表", "写的什么", "屏幕")
GLOBAL_HINTS = (
    "一共", "几种", "哪些", "总结", "概括", "整体", "全部", "整个课程", "贯穿", "对比", "比较", "有变化",
)

# --- usage prices, yuan per million tokens: (model, tier, cached, uncached, output)
PRICES = (
    ("deepseek-flash", "off_peak", 0.02, 1.0, 4.0),
    ("deepseek-flash", "peak", 0.04, 2.0, 8.0),
    ("deepseek-v4-pro", "off_peak", 0.16, 4.75, 14.26),
    ("deepseek-v4-pro", "peak", 0.32, 9.50, 28.52),
)
ASR_MODEL = "volc.bigasr.auc_turbo"
ASR_YUAN_PER_HOUR = 0.8

# --- course status labels
STATUS_LABELS = (
    ("pending", "待处理"),
    ("probing", "读取视频信息"),
    ("proxy", "生成播放代理"),
    ("audio", "抽取音频"),
    ("asr", "语音转写"),
    ("slides", "课件抽帧与 OCR"),
    ("segment", "语义分段"),
    ("summary", "生成分层摘要"),
    ("embed", "建立向量索引"),
    ("ready", "就绪"),
    ("failed", "失败"),
)

# --- media rule
GOOD_VIDEO_CODECS = ("h264", "vp8", "vp9", "av1")
GOOD_AUDIO_CODECS = ("aac", "mp3", "opus", "vorbis", "flac")

# --- speech service codes
CODE_OK = "20000000"
CODE_NO_SPEECH = "20000003"
CODES_PROCESSING = ("20000001", "20000002")
HTTP_RETRYABLE = (408, 425, 429, 500, 502, 503, 504)
FAILURE_HINTS = (
    (("error params", "invalid param", "param"), "bad_request"),
    (("no permission", "not granted", "unauthorized", "auth", "forbidden"), "no_access"),
    (("quota", "exceed", "limit", "qps"), "over_quota"),
    (("not found", "no such"), "missing_resource"),
)

# --- findings of the glossary in a notes document: kind -> label, hint (fixed values)
FINDING_LABELS = {
    "spaced_letters": ("转写噪音", "疑似转写噪音，请对照视频确认原词"),
    "quoted_phrase": ("疑为听错", "被当成专有名词引用，请确认是否为听错的词"),
    "inconsistent": ("拼写不一致", "同一实体两种拼写，必有一处是错的"),
    "listed": ("已标记", "术语表标记为待确认"),
}
# --- glossary: terms never flagged when quoted
TRUSTED_TERMS = (
    "uiautomator", "uiautomatorviewer", "DDMS", "ADB", "jadx-gui", "jeb", "Xposed", "EdXposed",
    "BuildProp Enhancer", "AES", "MD5", "Base64", "IV", "Cipher", "CLogUtils", "InfiniteLog",
    "AndroidManifest", "OkHttp", "Logcat", "SDK",
)

# --- patterns (valid for Java regex and RE2 alike, but for the first: RE2 writes it with \b and \s, which know only ASCII
# there; in Java \b takes accented letters for word characters, depending on its version, and \s the vertical tab for a blank)
RE_SPACED_LETTERS = r"(?<![A-Za-z0-9_])(?:[A-Za-z][\t\n\f\r ]){2,}[A-Za-z](?![A-Za-z0-9_])"
RE_QUOTED = r'["“]([A-Za-z][A-Za-z0-9 _./\\+-]{2,})["”]'
RE_IDENTIFIER = r"[A-Za-z][A-Za-z0-9]*(?:[_.][A-Za-z0-9]+)+"
RE_ANSWER_TIME = r"\[(?:时间\s*)?(\d{1,2}:\d{2}(?::\d{2})?)\]"
RE_GUIDE_TIME = r"(\d{1,3}:[0-5]\d)"
RE_BACKTICK = r"`([^`]+)`"
RE_TERM_WORD = r"[A-Za-z][A-Za-z0-9_.$\[\]]{2,}"
RE_HEADING_LINE = r"^#{1,3}\s+\S"
# Answers are compared without punctuation, [\s，。、；：？！,.;:?!"'“”‘’()（）[]【】《》<>·—-_/\|], and without
# anything outside [0-9a-zA-Z\u4e00-\u9fff^+-=<>()]. Both removals together leave digits, ASCII
# letters, Han and ^ + =, so one pass removes the complement (written as ranges, which is fast).
RE_ANSWER_REMOVED = r"[\x00-*,-/:-<>-@\[-\]_`{-\x{4dff}\x{a000}-\x{10ffff}]+"
RE_EXTENSION_BLOCK = r"(?m)^[ \t]*>[^\n]{0,17}拓展[^\n]*\n?(?:[ \t]*>[^\n]*(?:\n|$))*"
RE_OUTLINE_MARK = r"^\s*(?:#{1,6}\s*)?(?:\*\*)?\s*大纲\s*(?:\*\*)?\s*[:：]\s*$"
RE_OUTLINE_ITEM = r"^\s*(?:[-*•]|\d+[.、)）])\s*\S"
RE_KNOWN_HOST = (
    r"(?i)^(?:www\.)?(?:bilibili\.com|b23\.tv|youtube\.com|youtu\.be|m\.bilibili\.com)/"
)
