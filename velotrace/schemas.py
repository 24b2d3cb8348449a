"""Canonical tables. A null stands for what a file doesn't say; seq is the order within a file and never the order of rows."""

POINTS = (
    "activity_id string, seq long, lat double, lon double, elevation double, t_fit long, ts timestamp, heart_rate short, cadence short, power int, temperature byte, speed_sensor_ms double, src_distance_m double"
)
FILE_ID = "activity_id string, manufacturer int, garmin_product int, product_name string"
SESSION = (
    "activity_id string, total_distance_m double, total_ascent_m double, total_descent_m double, max_speed_ms double, avg_speed_ms double, total_elapsed_s double, total_timer_s double, sport short, sub_sport short"
)
ERRORS = "path string, reason string"
#: Seconds from 1970 to the FIT epoch, 1989-12-31 UTC.
FIT_EPOCH = 631065600
#: Two Earth radii: of the readers, and of the privacy trimmer.
EARTH_M, TRIM_EARTH_M = 6371003.0, 6371000.0
MAX_FILE = 104_857_600
