"""Message templates.  They are inputs; every function takes another catalogue.

``CATALOG[language]`` maps a key to its template.  English is complete; the other
two languages hold what short messages and summaries need, so longer texts in them
need a catalogue of the caller.
"""

CATALOG = {
    "en": {
        "day_names": ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"],
        "summary_dry": "Mainly dry weather is expected over the next {n} days (total {total} mm).",
        "summary_light": "Light rain is likely on {n_days} of the next {n} days (total {total} mm).",
        "summary_moderate": "Moderate rain is likely on {n_days} of the next {n} days (total {total} mm).",
        "summary_heavy": "Heavy rain is possible; total rainfall over {n} days about {total} mm.",
        "summary_temp": "Maximum temperature {tmax_lo}-{tmax_hi} °C and minimum {tmin_lo}-{tmin_hi} °C.",
        "normal_title": "Normal weather",
        "normal_text": "No adverse weather is expected. Continue normal farm operations.",
        "heavy_rain_title": "Heavy rainfall warning",
        "heavy_rain_text": "About {rain} mm of rain is expected on {day} (chance of {thr} mm or more: {prob}%).",
        "heavy_rain_action": "Open drainage channels, postpone sowing, fertiliser application and spraying, and keep harvested produce and fodder under cover.",
        "waterlogging_title": "Waterlogging risk",
        "waterlogging_text": "{rain3} mm is expected in {window} days on flat, clayey fields (slope {slope}°, clay {clay}%).",
        "waterlogging_action": "Make ridges and furrows or open field drains to remove standing water within 24 hours; avoid entering wet fields with machinery.",
        "dry_spell_title": "Dry spell - irrigation advisory",
        "dry_spell_text": "Only {rain3} mm of rain is expected in the next 3 days; crop water need is about {etc} mm.",
        "dry_spell_action": "Give protective irrigation of about {irr} mm, preferably by drip or sprinkler in the morning or evening; mulch to save soil moisture.",
        "sowing_ok_title": "Sowing window open",
        "sowing_ok_text": "Soil moisture is sufficient: about {cum} mm of rain received and expected.",
        "sowing_ok_action": "Kharif sowing can be taken up; use treated seed and sow along the contour on slopes.",
        "sowing_wait_title": "Wait before sowing",
        "sowing_wait_text": "Only about {cum} mm of rain so far; at least {need} mm is needed for safe sowing.",
        "sowing_wait_action": "Do not sow in dry soil; wait for adequate rain to avoid seed loss.",
        "spray_ok_title": "Spraying window",
        "spray_ok_text": "Good days for pesticide / fungicide spraying: {days}.",
        "spray_ok_action": "Spray in calm morning hours; avoid spraying within 6 hours of expected rain.",
        "spray_no_title": "Postpone spraying",
        "spray_no_text": "Rain or strong wind is expected on all of the next days.",
        "spray_no_action": "Postpone spraying and foliar fertiliser; chemicals will be washed off or drift.",
        "fert_avoid_title": "Postpone fertiliser top-dressing",
        "fert_avoid_text": "{rain2} mm of rain is expected in the next 48 hours.",
        "fert_avoid_action": "Delay urea / top-dressing until the heavy rain passes to prevent washing away of nutrients.",
        "heat_title": "Heat stress",
        "heat_text": "Maximum temperature up to {tmax} °C is expected on {day}.",
        "heat_action": "Irrigate in the evening, provide shade and drinking water to livestock, and avoid field work between 12 and 4 pm.",
        "cold_title": "Cold wave",
        "cold_text": "Minimum temperature may fall to {tmin} °C on {day}.",
        "cold_action": "Give light irrigation in the evening, cover nurseries, and keep livestock sheltered at night.",
        "frost_title": "Ground frost risk",
        "frost_text": "Minimum temperature may fall to {tmin} °C on {day}; low-lying valley fields are most at risk.",
        "frost_action": "Irrigate the evening before, cover seedlings, and create smoke on the windward side before dawn.",
        "thunder_title": "Thunderstorm and lightning",
        "thunder_text": "Thunderstorms are possible on {day} (chance of {thr} mm or more: {prob}%).",
        "thunder_action": "Avoid open fields and trees during thunderstorms; keep livestock indoors; secure harvested produce.",
        "wind_title": "Strong wind",
        "wind_text": "Winds up to {wind} km/h are expected on {day}.",
        "wind_action": "Provide staking to tall crops like sugarcane and banana; do not spray; secure polyhouse and shade nets.",
        "pest_fungal_title": "Pest and fungal risk",
        "pest_fungal_text": "Hot and humid weather (up to {tmax} °C, humidity {rh}%) favours pests and fungal diseases.",
        "pest_fungal_action": "Scout crops regularly; take up need-based preventive spray on a dry, calm morning.",
        "harvest_ok_title": "Harvest window",
        "harvest_ok_text": "{n} dry days are expected - good for harvesting and drying {crop}.",
        "harvest_ok_action": "Harvest mature crop and dry the produce well before storage.",
        "harvest_no_title": "Postpone harvest",
        "harvest_no_text": "Rain is expected during the harvest stage of {crop}.",
        "harvest_no_action": "Postpone harvesting; move harvested produce to a covered, raised place.",
        "crop_stage_line": "{crop} - {stage}",
        "disease_title": "{crop}: {disease} risk ({level})",
        "risk_levels": {"1": "low", "2": "moderate", "3": "high"},
        "disease_names": {
            "grape_downy_mildew": "Downy mildew",
            "grape_powdery_mildew": "Powdery mildew",
            "onion_thrips": "Thrips",
            "onion_purple_blotch": "Purple blotch",
            "pomegranate_bacterial_blight": "Bacterial blight (oily spot)",
            "rice_blast": "Blast",
            "potato_late_blight": "Late blight",
            "soybean_rust": "Rust",
            "wheat_rust": "Rust",
        },
        "disease_actions": {
            "grape_downy_mildew": "Spray a protective fungicide (e.g. mancozeb or copper) before the rain; improve canopy ventilation.",
            "grape_powdery_mildew": "Spray wettable sulphur or a recommended systemic fungicide; remove affected leaves.",
            "onion_thrips": "Monitor with blue sticky traps; spray recommended insecticide if more than 30 thrips per plant.",
            "onion_purple_blotch": "Spray a recommended fungicide with sticker; ensure field drainage.",
            "pomegranate_bacterial_blight": "Remove and destroy infected fruits and twigs; spray a recommended bactericide + copper after rain.",
            "rice_blast": "Avoid excess nitrogen; spray a recommended fungicide at first symptoms.",
            "potato_late_blight": "Spray a protective fungicide immediately; repeat after rain.",
            "soybean_rust": "Scout lower leaves; spray a recommended fungicide at first pustules.",
            "wheat_rust": "Grow resistant varieties; spray a recommended fungicide when rust appears.",
        },
        "bulletin_title": "Gram Panchayat Agromet Advisory",
        "gp": "Gram Panchayat",
        "district": "District",
        "block": "Block",
        "issued": "Issued",
        "valid": "Valid",
        "weather_forecast": "Weather forecast",
        "col_date": "Date",
        "col_rain": "Rain (mm)",
        "col_tmax": "Max temp (°C)",
        "col_tmin": "Min temp (°C)",
        "col_rh": "Humidity (%)",
        "col_wind": "Wind (km/h)",
        "overall_status": "Warning level",
        "weather_summary": "Weather summary",
        "general_advisory": "General advisory",
        "crop_advisory": "Crop advisories",
        "disease_advisory": "Pest & disease alerts",
        "footer": "Downscaled from the ECMWF block forecast using terrain, land cover and rainfall climatology. Issued by the District Agromet Unit (DAMU). Verify with the latest IMD bulletin.",
        "levels": {"green": "No warning", "yellow": "Be aware", "orange": "Be prepared", "red": "Take action"},
        "sms_prefix": "{gp}: ",
        "sms_normal": "Weather normal next {n} days. Rain {total}mm. Continue farm work.",
        "sms_heavy_rain": "HEAVY RAIN {rain}mm on {day}. Drain fields, stop spraying & fertiliser.",
        "sms_dry_spell": "Dry 3 days, irrigate ~{irr}mm.",
        "sms_heat": "Heat {tmax}C {day}, irrigate evening.",
        "sms_cold": "Cold {tmin}C {day}, protect crops.",
        "sms_wind": "Wind {wind}km/h {day}, no spraying.",
        "sms_thunder": "Thunderstorm risk {day}, stay safe.",
        "sms_spray_ok": "Spray on {days}.",
        "sms_disease": "{crop} {disease} risk.",
    },
    "mr": {
        "day_names": ["सोम", "मंगळ", "बुध", "गुरु", "शुक्र", "शनि", "रवि"],
        "summary_dry": "पुढील {n} दिवस हवामान मुख्यतः कोरडे राहण्याची शक्यता आहे (एकूण {total} मिमी).",
        "summary_light": "पुढील {n} पैकी {n_days} दिवस हलक्या पावसाची शक्यता आहे (एकूण {total} मिमी).",
        "summary_moderate": "पुढील {n} पैकी {n_days} दिवस मध्यम पावसाची शक्यता आहे (एकूण {total} मिमी).",
        "summary_heavy": "मुसळधार पावसाची शक्यता; {n} दिवसांत एकूण सुमारे {total} मिमी पाऊस.",
        "summary_temp": "कमाल तापमान {tmax_lo}-{tmax_hi} °से व किमान तापमान {tmin_lo}-{tmin_hi} °से राहील.",
    },
    "hi": {
        "day_names": ["सोम", "मंगल", "बुध", "गुरु", "शुक्र", "शनि", "रवि"],
        "summary_dry": "अगले {n} दिनों में मौसम मुख्यतः शुष्क रहने की संभावना है (कुल {total} मिमी)।",
        "summary_light": "अगले {n} में से {n_days} दिनों में हल्की वर्षा की संभावना है (कुल {total} मिमी)।",
        "summary_moderate": "अगले {n} में से {n_days} दिनों में मध्यम वर्षा की संभावना है (कुल {total} मिमी)।",
        "summary_heavy": "भारी वर्षा संभव; {n} दिनों में कुल लगभग {total} मिमी वर्षा।",
        "summary_temp": "अधिकतम तापमान {tmax_lo}-{tmax_hi} °से और न्यूनतम {tmin_lo}-{tmin_hi} °से रहेगा।",
    },
}
