"""Rule thresholds, disease criteria and the crop calendar.

They are inputs, not logic; every function that uses them takes a replacement.
"""

LEVELS = ["green", "yellow", "orange", "red"]

# Rain probabilities used by the rules, in mm per day.
PROBABILITY_MM = {"light": 2.5, "moderate": 15.6, "heavy": 64.5}

# Thresholds per rule (rain mm/day, temperature deg C, humidity %, wind km/h).
RULES = {
    "heavy_rain": {"yellow_mm": 35.5, "orange_mm": 64.5, "red_mm": 115.6, "orange_prob": 0.30, "red_prob": 0.60},
    "waterlogging": {"flat_slope_deg": 3.0, "clay_pct": 40.0, "trigger_mm": 50.0, "window_days": 3, "orange_multiplier": 2.0},
    "dry_spell": {"rain_mm": 2.5, "window_days": 3, "effective_rain": 0.8, "max_prob": 0.40,
                  "sensitive_stages": ["sowing", "vegetative", "flowering", "fruit_development"]},
    "sowing_window": {"months": [6, 7], "cumulative_mm": 65.0, "window_days": 3},
    "spray_window": {"max_rain_mm": 1.0, "max_prob": 0.30, "max_wind_kmh": 15.0},
    "fertiliser": {"avoid_mm": 15.6, "window_days": 2},
    "heat": {"yellow": 40.0, "orange": 42.0, "red": 45.0},
    "cold": {"yellow": 10.0, "orange": 7.0, "red": 4.0, "valley_tpi": -10.0, "frost_margin": 2.0},
    "thunderstorm": {"months": [3, 4, 5, 10, 11], "min_prob": 0.30, "min_tmax": 32.0, "min_rh": 50.0, "orange_prob": 0.60},
    "wind": {"yellow": 30.0, "orange": 40.0, "red": 60.0},
    "pest_fungal": {"tmax": 35.0, "rh": 70.0},
    "harvest": {"dry_days": 3, "rain_mm": 2.5},
}
OVERALL_EXCLUDED_CATEGORIES = ["disease"]
OVERALL_EXCLUDED_RULES = ["spray_window", "harvest", "sowing_window"]
ET0 = {"krs": 0.16, "gust_to_mean": 0.55}
SUMMARY = {"rain_day_mm": 2.5, "moderate_mm": 15.6, "heavy_mm": 64.5}

# Disease criteria, highest level first.
DISEASES = {
    "grape_downy_mildew": [
        {"level": 3, "when": {"tmean": {"ge": 10}, "rain_2day": {"ge": 10}, "rh": {"ge": 85}}, "min_days": 1},
        {"level": 2, "when": {"tmean": {"ge": 10}, "rain": {"ge": 2.5}, "rh": {"ge": 80}}, "min_days": 1},
    ],
    "grape_powdery_mildew": [
        {"level": 3, "when": {"tmin": {"ge": 15}, "tmax": {"le": 32}, "rain": {"lt": 10}}, "consecutive": 3},
        {"level": 1, "when": {"tmin": {"ge": 15}, "tmax": {"le": 32}, "rain": {"lt": 10}}, "min_days": 2},
    ],
    "onion_thrips": [
        {"level": 3, "when": {"tmax": {"ge": 30}, "rh": {"le": 60}, "rain": {"lt": 1}}, "consecutive": 3},
        {"level": 2, "when": {"tmax": {"ge": 30}, "rh": {"le": 60}, "rain": {"lt": 1}}, "min_days": 2},
    ],
    "onion_purple_blotch": [
        {"level": 3, "when": {"rh": {"ge": 80}, "tmean": {"ge": 21, "le": 30}, "rain": {"ge": 1}}, "min_days": 2},
        {"level": 2, "when": {"rh": {"ge": 80}, "tmean": {"ge": 21, "le": 30}, "rain": {"ge": 1}}, "min_days": 1},
    ],
    "pomegranate_bacterial_blight": [
        {"level": 3, "when": {"rain": {"ge": 2.5}, "tmean": {"ge": 25, "le": 35}, "rh": {"ge": 80}}, "min_days": 2},
        {"level": 2, "when": {"rain": {"ge": 2.5}, "tmean": {"ge": 25, "le": 35}, "rh": {"ge": 80}}, "min_days": 1},
    ],
    "rice_blast": [
        {"level": 3, "when": {"tmin": {"ge": 20, "le": 26}, "rh": {"ge": 90}, "rain": {"ge": 1, "le": 15}}, "min_days": 2},
        {"level": 2, "when": {"tmin": {"ge": 20, "le": 26}, "rh": {"ge": 90}, "rain": {"ge": 1, "le": 15}}, "min_days": 1},
    ],
    "potato_late_blight": [
        {"level": 3, "when": {"tmin": {"ge": 10}, "rh": {"ge": 90}}, "consecutive": 2},
        {"level": 1, "when": {"tmin": {"ge": 10}, "rh": {"ge": 90}}, "min_days": 1},
    ],
    "soybean_rust": [
        {"level": 3, "when": {"tmean": {"ge": 18, "le": 28}, "rh": {"ge": 85}, "rain": {"ge": 1}}, "min_days": 3},
        {"level": 2, "when": {"tmean": {"ge": 18, "le": 28}, "rh": {"ge": 85}, "rain": {"ge": 1}}, "min_days": 1},
    ],
    "wheat_rust": [
        {"level": 2, "when": {"tmean": {"ge": 15, "le": 25}, "rh": {"ge": 80}}, "min_days": 2},
    ],
}

# Crops with their parents, diseases and stages (name, type, start, end, Kc); windows are MM-dd and may wrap.
CROPS = {
    "rice": {
        "name": "Paddy (rice)",
        "parents": ["MAVAL", "MULSHI", "VELHE", "BHOR", "AMBEGAON", "JUNNAR", "KHED", "HAVELI"],
        "diseases": ["rice_blast"],
        "stages": [
            ("Nursery / sowing", "sowing", "06-10", "07-05", 1.05),
            ("Transplanting / tillering", "vegetative", "07-06", "08-31", 1.10),
            ("Panicle initiation / flowering", "flowering", "09-01", "09-30", 1.20),
            ("Grain filling", "fruit_development", "10-01", "10-25", 1.05),
            ("Harvest", "harvest", "10-26", "11-20", 0.90),
        ],
    },
    "soybean": {
        "name": "Soybean",
        "parents": ["KHED", "JUNNAR", "AMBEGAON", "HAVELI", "SHIRUR", "BHOR", "PURANDAR"],
        "diseases": ["soybean_rust"],
        "stages": [
            ("Sowing / emergence", "sowing", "06-15", "07-10", 0.40),
            ("Vegetative", "vegetative", "07-11", "08-20", 0.80),
            ("Flowering", "flowering", "08-21", "09-15", 1.15),
            ("Pod development", "fruit_development", "09-16", "10-05", 1.10),
            ("Maturity / harvest", "harvest", "10-06", "10-31", 0.50),
        ],
    },
    "bajra": {
        "name": "Pearl millet (bajra)",
        "parents": ["BARAMATI", "INDAPUR", "DAUND", "SHIRUR", "PURANDAR"],
        "diseases": [],
        "stages": [
            ("Sowing", "sowing", "06-20", "07-15", 0.35),
            ("Vegetative", "vegetative", "07-16", "08-20", 0.70),
            ("Flowering", "flowering", "08-21", "09-10", 1.00),
            ("Grain filling", "fruit_development", "09-11", "09-30", 0.80),
            ("Harvest", "harvest", "10-01", "10-20", 0.30),
        ],
    },
    "rabi_jowar": {
        "name": "Rabi sorghum (jowar)",
        "parents": ["BARAMATI", "INDAPUR", "DAUND", "PURANDAR", "SHIRUR"],
        "diseases": [],
        "stages": [
            ("Sowing", "sowing", "09-20", "10-20", 0.30),
            ("Vegetative", "vegetative", "10-21", "12-10", 0.75),
            ("Flowering", "flowering", "12-11", "01-10", 1.00),
            ("Grain filling", "fruit_development", "01-11", "02-10", 0.80),
            ("Harvest", "harvest", "02-11", "03-10", 0.55),
        ],
    },
    "wheat": {
        "name": "Wheat",
        "parents": ["JUNNAR", "KHED", "AMBEGAON", "SHIRUR", "HAVELI"],
        "diseases": ["wheat_rust"],
        "stages": [
            ("Sowing", "sowing", "11-01", "11-30", 0.40),
            ("Crown root / tillering", "vegetative", "12-01", "01-15", 0.80),
            ("Flowering", "flowering", "01-16", "02-10", 1.15),
            ("Grain filling", "fruit_development", "02-11", "03-10", 1.00),
            ("Harvest", "harvest", "03-11", "04-05", 0.35),
        ],
    },
    "gram": {
        "name": "Chickpea (gram)",
        "parents": ["BARAMATI", "INDAPUR", "DAUND", "SHIRUR", "PURANDAR", "JUNNAR", "KHED"],
        "diseases": [],
        "stages": [
            ("Sowing", "sowing", "10-15", "11-15", 0.40),
            ("Vegetative / branching", "vegetative", "11-16", "12-20", 0.75),
            ("Flowering", "flowering", "12-21", "01-20", 1.00),
            ("Pod filling", "fruit_development", "01-21", "02-15", 0.90),
            ("Harvest", "harvest", "02-16", "03-10", 0.35),
        ],
    },
    "onion": {
        "name": "Onion",
        "parents": ["JUNNAR", "KHED", "AMBEGAON", "SHIRUR", "BARAMATI", "PURANDAR", "INDAPUR"],
        "diseases": ["onion_thrips", "onion_purple_blotch"],
        "stages": [
            ("Kharif transplanting", "sowing", "07-01", "07-31", 0.70),
            ("Kharif vegetative", "vegetative", "08-01", "09-10", 0.85),
            ("Kharif bulb development", "fruit_development", "09-11", "10-15", 1.05),
            ("Kharif harvest", "harvest", "10-16", "11-14", 0.75),
            ("Rabi transplanting", "sowing", "11-15", "12-31", 0.70),
            ("Rabi vegetative", "vegetative", "01-01", "02-15", 0.85),
            ("Rabi bulb development", "fruit_development", "02-16", "03-31", 1.05),
            ("Rabi harvest / curing", "harvest", "04-01", "04-30", 0.75),
        ],
    },
    "potato": {
        "name": "Potato",
        "parents": ["KHED", "AMBEGAON", "JUNNAR"],
        "diseases": ["potato_late_blight"],
        "stages": [
            ("Planting", "sowing", "06-15", "07-10", 0.50),
            ("Vegetative", "vegetative", "07-11", "08-15", 0.90),
            ("Tuber bulking", "fruit_development", "08-16", "09-25", 1.15),
            ("Harvest", "harvest", "09-26", "10-20", 0.75),
        ],
    },
    "sugarcane": {
        "name": "Sugarcane",
        "parents": ["BARAMATI", "INDAPUR", "DAUND", "SHIRUR", "HAVELI", "PURANDAR", "JUNNAR"],
        "diseases": [],
        "stages": [
            ("Tillering", "vegetative", "02-01", "05-31", 0.80),
            ("Grand growth", "vegetative", "06-01", "10-31", 1.25),
            ("Maturity / crushing", "harvest", "11-01", "01-31", 0.75),
        ],
    },
    "grapes": {
        "name": "Grapes",
        "parents": ["JUNNAR", "BARAMATI", "INDAPUR", "PURANDAR", "HAVELI"],
        "diseases": ["grape_downy_mildew", "grape_powdery_mildew"],
        "stages": [
            ("Foundation (April) pruning", "rest", "04-01", "04-30", 0.30),
            ("Cane development", "vegetative", "05-01", "09-30", 0.70),
            ("Fruit (October) pruning", "vegetative", "10-01", "10-20", 0.45),
            ("Flowering / fruit set", "flowering", "10-21", "11-30", 0.80),
            ("Berry development", "fruit_development", "12-01", "02-15", 0.85),
            ("Harvest", "harvest", "02-16", "03-31", 0.45),
        ],
    },
    "pomegranate": {
        "name": "Pomegranate (mrig bahar)",
        "parents": ["PURANDAR", "BARAMATI", "INDAPUR", "DAUND", "SHIRUR"],
        "diseases": ["pomegranate_bacterial_blight"],
        "stages": [
            ("Rest / bahar treatment", "rest", "01-01", "05-31", 0.40),
            ("Flowering", "flowering", "06-01", "07-15", 0.75),
            ("Fruit development", "fruit_development", "07-16", "10-31", 0.90),
            ("Harvest", "harvest", "11-01", "12-31", 0.65),
        ],
    },
}
