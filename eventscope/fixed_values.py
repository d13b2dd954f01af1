"""Names, orders and constants that results depend on."""

# Association modes and the event type that is drawn as a shape.
CATEGORY = "CATEGORY"
NARRATIVE = "NARRATIVE"
FILTER = "FILTER"
SHAPE = "SHAPE"

# Event ids with a role of their own.
CONNECT = "cowrie.session.connect"
CLOSED = "cowrie.session.closed"

# Prefix of the association that names a session's stage.
STAGE_PREFIX = "stage:"

# Stage ladder, furthest step first, as (stage, event ids, event id prefixes).
STAGES = [
    (
        "cowrie.session.file_download",
        (
            "cowrie.session.file_download",
            "cowrie.session.file_download.failed",
            "cowrie.session.file_upload",
        ),
        (),
    ),
    ("cowrie.direct-tcpip.request", (), ("cowrie.direct-tcpip.",)),
    ("cowrie.command.input", (), ("cowrie.command.",)),
    ("cowrie.login.success", ("cowrie.login.success",), ()),
    ("cowrie.login.failed", ("cowrie.login.failed",), ()),
    ("cowrie.session.connect", (), ("",)),
]

# Colour of each stage.
STAGE_COLOURS = {
    "cowrie.session.file_download": "#d64550",
    "cowrie.direct-tcpip.request": "#a970c9",
    "cowrie.command.input": "#e8973a",
    "cowrie.login.success": "#3fb950",
    "cowrie.login.failed": "#d9b23a",
    "cowrie.session.connect": "#4a9edd",
}

# Order of event types, from handshake to teardown.
EVENT_ORDER = [
    "cowrie.session.connect",
    "cowrie.client.version",
    "cowrie.client.kex",
    "cowrie.client.fingerprint",
    "cowrie.client.size",
    "cowrie.client.var",
    "cowrie.client.malformed_packet",
    "cowrie.login.failed",
    "cowrie.login.success",
    "cowrie.session.params",
    "cowrie.command.input",
    "cowrie.command.failed",
    "cowrie.command.success",
    "cowrie.command.chpasswd",
    "cowrie.session.input",
    "cowrie.session.file_download",
    "cowrie.session.file_download.failed",
    "cowrie.session.file_upload",
    "cowrie.direct-tcpip.request",
    "cowrie.direct-tcpip.data",
    "cowrie.direct-tcpip.tunnel",
    "cowrie.direct-tcpip.redirect",
    "cowrie.direct-tcpip.ja4",
    "cowrie.direct-tcpip.ja4h",
    "cowrie.telnet.option",
    "cowrie.telnet.exploit_attempt",
    "cowrie.telnet.exploit_success",
    "cowrie.telnet.error",
    "cowrie.proxy.backend_connected",
    "cowrie.proxy.backend_disconnected",
    "cowrie.proxy.backend_connect_error",
    "cowrie.proxy.client_disconnect",
    "cowrie.proxy.ssh",
    "cowrie.reversedns.connect",
    "cowrie.reversedns.forward",
    "cowrie.virustotal.scanfile",
    "cowrie.virustotal.scanurl",
    "cowrie.urlhaus.submitted",
    "cowrie.greynoise.result",
    "cowrie.abuseipdb.started",
    "cowrie.abuseipdb.reportedip",
    "cowrie.abuseipdb.reportfail",
    "cowrie.abuseipdb.ratelimited",
    "cowrie.abuseipdb.wakeup",
    "cowrie.log.open",
    "cowrie.log.closed",
    "cowrie.session.closed",
]

# Fields repeated on every log event of a session.
ENVELOPE = ["eventid", "session", "sensor", "uuid", "src_ip", "protocol"]

# Map clustering (pixels, tile size, zooms) and steps flown past the expansion zoom.
CLUSTER_RADIUS = 30
TILE_SIZE = 512
MIN_ZOOM = 2
MAX_ZOOM = 16
ZOOM_STEPS_TO_FLY = 2

# Time window widths in minutes.
ZOOM_LEVELS = {
    "20 years": 10512000,
    "2 years": 1051200,
    "3 months": 129600,
    "3 days": 4320,
    "12 hours": 720,
    "1 hour": 60,
}

# Default text formats of an event's date and time.
DATE_FORMAT = "MM/dd/yyyy"
TIME_FORMAT = "HH:mm"

# Attributes that a text search looks at.
SEARCH_COLUMNS = ["description", "location", "category", "date"]

# Media type by path pattern, first match wins.
MEDIA_TYPES = [
    (r"\.(png|jpg|jpeg)$", "Image"),
    (r"\.mp4$", "Video"),
    (r"\.md$", "Text"),
    (r"\.pdf$", "Document"),
    (r".+twitter\.com.+", "Tweet"),
    (r".+t\.me.+", "Telegram"),
]
MEDIA_TYPES_SHORT = [
    (r"\.(png|jpg)$", "Image"),
    (r"\.mp4$", "Video"),
    (r"\.md$", "Text"),
]
TWEET_ID = r"https?://twitter.com/[0-9a-zA-Z_]{1,20}/status/([0-9]*)"

# Text and list fields of an event.
EVENT_TEXT = [
    "id", "description", "date", "time", "time_precision", "location", "latitude",
    "longitude", "x", "y", "z", "type", "category", "category_full", "comments",
    "time_display", "shape", "colour",
]
EVENT_LISTS = ["associations", "sources", "narrative___stepStyles"]

# Text and list fields of the lookup tables.
DIMENSION_TEXT = {
    "associations": ["id", "title", "desc", "mode"],
    "sites": ["id", "description", "site", "latitude", "longitude", "enabled"],
    "sources": ["id", "title", "thumbnail", "type", "url", "description", "parent", "author", "date", "notes"],
    "regions": ["name"],
    "shapes": ["id", "title", "shape", "colour"],
}
DIMENSION_LISTS = {
    "associations": ["filter_paths"],
    "sites": [],
    "sources": ["paths", "affil_s"],
    "regions": ["items"],
    "shapes": [],
}
