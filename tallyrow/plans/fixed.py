"""Fixed values shared by several operators.

These must equal the published ones for results to agree.
"""

# Default time-delta bucket edges in seconds (63 edges, 64 bucket ids).
TIME_BUCKET_EDGES = [
    5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60,
    120, 180, 240, 300, 360, 420, 480, 540, 600,
    900, 1200, 1500, 1800, 2100, 2400, 2700, 3000, 3300, 3600,
    5400, 7200, 9000, 10800, 12600, 14400, 16200, 18000, 19800, 21600,
    32400, 43200, 54000, 64800, 75600, 86400,
    172800, 259200, 345600, 432000, 518400, 604800,
    1123200, 1641600, 2160000, 2592000,
    4320000, 6048000, 7776000,
    11664000, 15552000,
    31536000,
]

# Ids of the derived dense blocks.
COUNT_FID = 900001
SEQ_STATS_FID = 900002
HISTORY_FID = 900003
TIME_OF_DAY_FID = 900004
HOUR_ONLY_FID = 900005
MISSING_FID = 900006
LOCAL_TIME_FID = 900007
LOCAL_TIME_V2_FID = 900008

# Dense fids that hold raw counts and are log-scaled by default.
LOG1P_DENSE_FIDS = (62, 63, 64, 65, 66)

# Report percentiles.
LENGTH_PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99, 99.9)
VALUE_PERCENTILES = (1, 5, 25, 50, 75, 95, 99)

# Local clock offset (UTC+8) and day arithmetic.
LOCAL_OFFSET = 28800
HOUR = 3600
DAY = 86400

# Names and inclusive local hours of the five dayparts.
DAYPARTS = (
    ("00_05", 0, 5),
    ("06_08", 6, 8),
    ("09_14", 9, 14),
    ("15_20", 15, 20),
    ("21_23", 21, 23),
)

DEFAULT_SEQ_LEN = 256
