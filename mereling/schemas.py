"""Schemas of the tables that stages read and write, as DDL; nothing is inferred."""


BOX = "struct<ulx: double, uly: double, lrx: double, lry: double>"
SCENES = ("scene string, satellite string, product_level string, sensing_time timestamp_ntz, baseline string, orbit string, tile string, discriminator string")
PIXELS = ("scene string, band string, y int, x int, dn int")
BLOCKS = ("scene string, band string, chunk int, h int, w int, dn array<int>")
CLOUD = ("scene string, y int, x int, cls int")
LAND_COVER = ("y int, x int, class int")
FEATURES = ("layer string, geom_id bigint, kind string, vertices array<struct<x: double, y: double>>")
LABEL_LINES = ("file string, line_no bigint, value string")
LABEL_ROWS = (f"file string, line_no bigint, chunk int, reservoirs int, water_bodies int, res_boxes array<{BOX}>, body_boxes array<{BOX}>")
LABEL_EVENTS = ("tile string, chunk int, version bigint, at timestamp, value string, deleted boolean")
PATCHES = ("class string, scene_prefix string, idx bigint, h int, w int, px array<smallint>")
PREDICTIONS = ("chunk int, minichunk int, label string, confidence float")
METADATA = ("crs string, a double, b double, c double, d double, e double, f double, width int, height int")
