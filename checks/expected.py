"""Fixed values that results must show, written out so that the SQL does not share them with the code."""

TRAIN_SYSTEM = (
    "You are a cybersecurity email classifier. Decide whether the email is phishing or legitimate. "
    "Return exactly one word only: phishing or legitimate."
)
EVAL_SYSTEM = (
    "You are a cybersecurity email classifier. Decide whether the email is phishing or legitimate. "
    "Do not copy the email. Do not explain. Output only one label: phishing or legitimate."
)
DEFAULT_SYSTEM = "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."
TOOLS_INTRO = (
    "\n\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\n"
    "You are provided with function signatures within <tools></tools> XML tags:\n<tools>"
)
TOOLS_OUTRO = (
    "\n</tools>\n\nFor each function call, return a json object with function name and arguments within "
    "<tool_call></tool_call> XML tags:\n<tool_call>\n"
    '{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'
)
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>\n"
TRUNCATION_MARK = "\n\n[...truncated...]\n\n"
NO_SUBJECT = "無主旨"
SUBJECT_AS_BODY = "[系統智慧分析模式：已由主旨自動代入]\n"
SENSITIVE_WORDS = [
    "account", "attachment", "bank", "confirm", "credential", "expire", "invoice", "login", "password", "payment",
    "suspend", "transfer", "urgent", "verify", "wire",
]
TARGET_BANDS = {
    "Accuracy": (0.80, 0.92),
    "Precision": (0.75, 0.92),
    "Recall": (0.85, 0.95),
    "F1-score": (0.82, 0.93),
}
TOOL_SPEC = (
    '{"type": "function", "function": {"name": "look_up", "description": "Finde « Absender »", '
    '"parameters": {"type": "object"}}}'
)

# By outcome of the gate: the reason, then level, action and details as shown on the screen.
GATE_TEXTS = {
    'blank': (
        'no mail text was given',
        '無',
        '⚠️ 錯誤',
        '請先輸入測試文本（主旨或內文）',
    ),
    'phishing': (
        'the model takes the mail for phishing; it is blocked',
        'HIGH (高風險)',
        '🚨 攔截並發出警報 (BLOCK) —— 專屬模型判定為 Phishing 威脅',
        '【模型偵測結果】: {answer}\n【資安決策】: 模型認定此郵件包含高度商業郵件詐騙 (BEC) 特徵，系統已強制阻斷。',
    ),
    'legitimate': (
        'the model sees no sign of phishing; it is delivered',
        'LOW (低風險)',
        '🟢 安全放行 (PASS) —— 專屬模型判定為 Legitimate 安全',
        '【模型偵測結果】: {answer}\n【資安決策】: 模型評估此郵件無可疑社交工程特徵，准予放行至員工收件匣。',
    ),
    'strict': (
        'no usable answer, and the strict threshold blocks such mail',
        'UNKNOWN (無法辨識)',
        '🚨 攔截控制 (BLOCK) —— 模型輸出異常({answer})，依防禦政策強制阻斷！',
        '【異常處理】: 模型無法給出明確標籤。因為網頁端設定的門檻為 {threshold} (屬嚴格政策)，資安系統採取『寧可錯殺』方針。',
    ),
    'lenient': (
        'no usable answer, and the lenient threshold delivers such mail',
        'UNKNOWN (無法辨識)',
        '🟢 異常放行 (PASS) —— 模型輸出異常({answer})，依防禦政策容忍放行。',
        '【異常處理】: 模型無法給出明確標籤。因為網頁端設定的門檻為 {threshold} (屬寬鬆政策)，系統選擇放行。',
    ),
}
