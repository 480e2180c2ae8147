"""Fixed values that results depend on."""

#: Kind, type, rank, width m, lanes, largest grade, least curve radius m.
ROAD_TYPES = [
    (0, "freeway", 9.0, 22.0, 4, 0.05, 350.0),
    (1, "highway", 8.0, 10.2, 2, 0.08, 150.0),
    (2, "arterial", 6.0, 14.0, 4, 0.08, 60.0),
    (3, "collector", 5.0, 9.0, 2, 0.10, 35.0),
    (4, "residential", 3.0, 7.5, 2, 0.12, 12.0),
    (5, "dirt", 1.0, 3.8, 1, 0.15, 8.0),
]
#: Metres a pixel, image size, chunk size in pixels.
METRES, WIDTH, HEIGHT, CHUNK = 2.5, 2000, 667, 100
#: Clearance above water by class of waterway, m.
CLEARANCE = {"river": 6.0, "creek": 3.5, "slough": 3.0}
#: Compass names from east by quarter turns against the clock.
COMPASS = ["eastbound", "northbound", "westbound", "southbound"]
#: The kind of a junction by the first condition that holds; lo and hi are its smallest and largest angle between neighbouring legs.
JUNCTION_KINDS = [
    ("degree = 1", "end"),
    ("degree = 2", "type_change"),
    ("separated", "merge"),
    ("degree = 3 and lo < 40", "fork"),
    ("degree = 3 and (straight or abs(hi - 180) < 30)", "city or T"),
    ("degree = 3 and hi > 200", "fork"),
    ("degree = 4", "city, cross or angled"),
    ("degree = 3", "angled"),
    ("true", "multi"),
]
#: What such a kind is in town, where legs are square, and elsewhere.
KIND_CHOICES = {"city or T": ("city", "T", "T"), "city, cross or angled": ("city", "cross", "angled")}
#: The control of a leg by the first condition that holds; major is the highest rank among the other legs, null stands for none.
CONTROLS = [
    ("type in ('driveway', 'freeway') or outbound", None),
    ("signals", "signal"),
    ("dense and legs >= 4 and big >= 3", "all_stop"),
    ("type = 'ramp' and major >= 5", "stop"),
    ("type = 'ramp' or rank >= major", None),
    ("rank <= 4 and major >= 5", "stop"),
    ("rank = 5 and major >= 6", "stop"),
    ("rank <= 3 and major = 4", "yield"),
]
#: Rank of a ramp, and the types that count as big at a junction.
RAMP_RANK, BIG_TYPES = 0.5, ("main_street", "arterial")
