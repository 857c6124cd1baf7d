"""Fixed values of the label model and of tissue acoustics."""

# Raw class, label code.
CLASS_TO_LABEL = (
    (0, 0), (1, 12), (2, 6), (3, 6), (4, 8), (5, 11), (6, 8), (7, 12), (8, 12), (9, 12),
    (10, 2), (11, 2), (12, 2), (13, 2), (14, 2), (15, 8), (16, 0), (17, 0), (18, 8), (19, 12),
    (20, 8), (21, 0), (22, 0), (23, 6), (24, 6), (25, 13), (26, 13), (27, 13), (28, 13), (29, 13),
    (30, 13), (31, 13), (32, 13), (33, 13), (34, 13), (35, 13), (36, 13), (37, 13), (38, 13), (39, 13),
    (40, 13), (41, 13), (42, 13), (43, 13), (44, 13), (45, 13), (46, 13), (47, 13), (48, 13), (49, 13),
    (50, 13), (51, 8), (52, 4), (53, 4), (54, 8), (55, 4), (56, 4), (57, 4), (58, 4), (59, 4),
    (60, 4), (61, 4), (62, 4), (63, 4), (64, 4), (65, 4), (66, 4), (67, 4), (68, 4), (69, 13),
    (70, 13), (71, 13), (72, 13), (73, 13), (74, 13), (75, 0), (76, 0), (77, 0), (78, 0), (79, 0),
    (80, 0), (81, 0), (82, 0), (83, 0), (84, 0), (85, 0), (86, 0), (87, 0), (88, 0), (89, 0),
    (90, 0), (91, 0), (92, 13), (93, 13), (94, 13), (95, 13), (96, 13), (97, 13), (98, 13), (99, 13),
    (100, 13), (101, 13), (102, 13), (103, 13), (104, 13), (105, 13), (106, 13), (107, 13), (108, 13), (109, 13),
    (110, 13), (111, 13), (112, 13), (113, 13), (114, 13), (115, 13), (116, 13), (117, 0),
)

# Label, tissue, impedance, attenuation, mu0, mu1, sigma0.
TISSUES = (
    (2, "lung", 0.0004, 1.64, 0.78, 0.56, 0.1),
    (3, "fat", 1.38, 0.63, 0.5, 0.5, 0.0),
    (4, "vessel", 1.61, 0.18, 0.001, 0.0, 0.01),
    (6, "kidney", 1.62, 1.0, 0.45, 0.6, 0.3),
    (8, "muscle", 1.62, 1.09, 0.45, 0.64, 0.1),
    (9, "background", 0.3, 0.54, 0.3, 0.2, 0.0),
    (11, "liver", 1.65, 0.7, 0.4, 0.8, 0.14),
    (12, "soft tissue", 1.63, 0.54, 0.45, 0.64, 0.1),
    (13, "bone", 7.8, 5.0, 0.78, 0.56, 0.1),
)
# Label, red, green, blue, alpha; all other labels are opaque black.
PALETTE = ((2, 220, 30, 30, 255), (3, 170, 80, 0, 31), (4, 0, 170, 0, 255), (6, 0, 175, 20, 255), (8, 0, 170, 190, 255), (11, 0, 120, 230, 255), (12, 115, 65, 200, 31), (13, 255, 0, 150, 255))
# Points of a label.
QUOTA = {2: 100_000, 3: 100_000, 4: 100_000, 6: 100_000, 8: 100_000, 11: 100_000, 12: 400_000, 13: 100_000}
DENSITY = (-200, 250)
BLOB_SIZE = (10, 30)
BOUNDARY_SCALE, TGC, SCATTER_SLOPE = 0.1, 8.0, 10.0
