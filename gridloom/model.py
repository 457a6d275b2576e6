"""Schemas of the data model: chunks, voxels, fields, surfaces, lines, edges, metrics."""

from __future__ import annotations

#: A dense array as sparse chunks: a chunk that holds only the fill value has no row.
CHUNKS = "array string, level int, cz int, cy int, cx int, payload binary"
VOXELS = "array string, level int, z bigint, y bigint, x bigint, v int"
#: One column a plane, so that reading two planes reads two columns.
FIELDS = "z bigint, y bigint, x bigint, pc int, ps int, t0 int, t1 int, t2 int, t3 int, t4 int, t5 int, sp int, w int"
SURFACES = "surface_id string, row int, col int, x float, y float, z float"
LINES = "line_id bigint, family string, points array<struct<z:double,y:double,x:double>>"
EDGES = "a bigint, b bigint, d int, w bigint, wn bigint"
METRICS = "tag string, box string, scroll string, ids double, ceil double"
SOURCES = "sources array<struct<name:string,root:string,ct:string,um:double,axis:string,weight:double>>"
ANNOTATIONS = "op string, id bigint, item struct<z:double,y:double,x:double,kind:string>"

#: Sides of an inner chunk and of a shard, in voxels.
CHUNK, SHARD = 128, 1024
#: Cyclic phase codes have this period; unknown is null.
PERIOD = 252
