"""Labels, headers and limits that users of the rule files,
status tables and CSV exports rely on."""

# Rule targets as written in rule files.
TARGET_CONTENT = "內容"
TARGET_FILE_NAME = "檔名"
TARGET_METADATA = "元數據"
LEGACY_TARGET_METADATA = "中介"
TARGET_CODES = {"1": "內容", "2": "檔名", "3": "元數據"}

# Columns of a rule file, by position.
RULE_HEADER = ["關鍵字", "目標檔名", "原則", "重複次數", "開啟密碼", "編輯密碼"]

# Status codes, their labels and messages.
WAITING, RUNNING, DONE, FAILED = 0, 1, 2, 3
STATUS_LABELS = {0: "等待處理", 1: "處理中", 2: "已完成", 3: "失敗"}
WAITING_MESSAGE = "等待處理"
RUNNING_MESSAGE = "處理中"
DONE_MESSAGE = "處理完成"
FAILED_MESSAGE_PREFIX = "處理文件時出錯: "

# Log levels by number, the default, the one shown as an error, the unknown.
LEVEL_LABELS = {10: "調試", 20: "信息", 30: "警告", 40: "错误", 50: "嚴重"}
LEVEL_DEFAULT = "信息"
LEVEL_ERROR = "错误"
UNKNOWN = "未知"

# CSV export headers.
STATUS_EXPORT_HEADER = ["文件路徑", "狀態", "消息", "線程ID", "開始時間", "結束時間"]
LOG_EXPORT_HEADER = ["時間戳", "級別", "線程", "消息"]
BYTE_ORDER_MARK = "\ufeff"

# Text formats.
PAGE_MARKER_OPEN = "===== 第"
PAGE_MARKER_CLOSE = "頁 =====\n"
PAGE_MARKER_RULE = "====="
PREVIEW_SUFFIX = "...（內容已截斷）"
PREVIEW_PAGE_CHARS = 500
PREVIEW_WHOLE_CHARS = 1000
SIDECAR_SUFFIX = "_ocr.txt"
DURATION_HOURS, DURATION_MINUTES, DURATION_SECONDS = "小時", "分", "秒"

# A target name may be taken as name, name_1 ... name_99.
SLOTS_PER_NAME = 100
