"""Contract constants: values that change results."""

# Fixed values.
OUTLIER_Z, END_FADE, RUN_MINIMUM = 2.5, 0.85, 3
RUN_CHARS, TAIL_CHARS = 60, 52
AUDIT_MAX_FIX, AUDIT_SLACK = 3, 2
GRAM = 6
CROSS_MIN_TOKENS, CROSS_COUNT = 50, 5
WITHIN_MIN_TOKENS, WITHIN_COUNT = 12, 8
MULTI_MIN_TOKENS, MULTI_COUNT, MULTI_MID_PERCENT, MULTI_PREFIX = 50, 5, 85, 24
TAIL_WORDS, TAIL_MAX_RATE, TAIL_FLOOR, TAIL_SLACK = 12, 4.5, 0.001, 5
LOW_P, WORST = 0.5, 5
TAIL_GRAM_COUNT, NORMAL_RATE, IMPOSSIBLE_TIMES, LOOP_FLOOR = 3, 2.5, 3, 0.01
CLIP_MAX_GRAM, SUFFIX_PERIOD, SUFFIX_REPEATS, DECODE_WINDOW, WINDOW_TOLERANCE = 1, 5, 3, 30, 1
WPM_LOW, WPM_HIGH = 70, 300
COVER_SLACK, COVER_PERCENT = 15, 95
INTERIOR_GAP, EDGE_GAP, MIN_SPAN = 60, 180, 1
CHUNK_WORDS, CHUNK_MIN_FINAL = 22_000, 8_000
EDGE_WORDS, EDGE_SECONDS, EDGE_DEPTH, ANCHOR_RUN = 120, 180, 8, 3
PHRASE_CAP, SINGLE_CAP, SNIPPETS, OCCURRENCES, SNIPPET_CHARS = 500, 300, 2, 24, 120
MATCH_CAP, MATCH_MIN_LENGTH, MATCH_MAX_DISTANCE, MATCH_DIVISOR = 200, 4, 2, 3
EWMA_ALPHA, DEFAULT_CHAPTERS, DEFAULT_CHUNKS, REDO_SHARE = 0.3, 60, 8, 0.04
LANES = {"asr": 1, "audio": 1, "agent": 2}
SHINGLE = 8
EXCERPT_WORDS, MIN_CHAPTERS, OUTLIER_RATIO = 2000, 3, 10
PAGE_LIMIT = 500
#: The tag of normalised transcripts is a parameter of the readers; this is the default.
TRANSCRIPT_SCHEMA = "transcript/v1"
POSITION_UNKNOWN = 1e18
RETENTION_DAYS = 30

#: A side is broadcast only after a count finds this many rows or fewer; beyond it the join is shuffled.
BROADCAST_ROWS = 500_000
