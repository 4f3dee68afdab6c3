"""Sensor lists of the daily reports. Fixed values."""

COUNTED = [
    "L0003", "L0010", "L0013", "L0014", "L0015", "L0023", "L0027", "L0032", "L0033", "L0035",
    "L0041", "L0042", "L0045", "L0049", "L0059", "L0068", "L0070", "L0073", "L0075", "L0078",
    "L0079", "L0080", "L0082", "L0083", "L0085", "L0093", "L0095",
]

LIMITED = [
    "L0003", "L0010", "L0013", "L0014", "L0023", "L0027", "L0032", "L0033", "L0035",
    "L0041", "L0042", "L0048", "L0056", "L0065", "L0067", "L0070", "L0072", "L0075",
    "L0076", "L0077", "L0079", "L0080", "L0082", "L0090", "L0091", "L0092", "L0094",
]

MATRIX = [
    "L0013", "L0014", "L0023", "L0032", "L0033", "L0041", "L0042", "L0048", "L0067", "L0075",
    "L0080", "L0090", "L0092",
]

PAIR = ["L0091", "L0080"]
CLUSTERED = ["L0067", "L0075", "L0080"]
OUTLIER = "L0080"
STATUS = "L0082"
CURRENT = "L0059"

DEVICE_LABEL = "LiMo"
