"""Column names, codes and parameters of the road-accident table the analyses were made for.

All operators take columns and codes as arguments; these are the arguments for that table.
"""

from pyspark.sql import types as T

# --- Fixed values: column names, label texts, codes and model parameters that results depend on. ---

SOURCE_TYPES = T.StructType(
    [
        T.StructField("_c0", T.IntegerType()),
        T.StructField("Accident_Severity", T.IntegerType()),
        T.StructField("Date", T.StringType()),
        T.StructField("Time", T.StringType()),
        T.StructField("Year", T.IntegerType()),
        T.StructField("Day_of_Week", T.IntegerType()),
        T.StructField("Urban_or_Rural_Area", T.IntegerType()),
        T.StructField("Speed_limit", T.IntegerType()),
        T.StructField("Longitude", T.DoubleType()),
        T.StructField("Latitude", T.DoubleType()),
        T.StructField("Location_Easting_OSGR", T.DoubleType()),
        T.StructField("Location_Northing_OSGR", T.DoubleType()),
        T.StructField("Number_of_Vehicles", T.IntegerType()),
        T.StructField("Number_of_Casualties", T.IntegerType()),
        T.StructField("Police_Force", T.StringType()),
        T.StructField("Local_Authority_(District)", T.StringType()),
        T.StructField("Local_Authority_(Highway)", T.StringType()),
        T.StructField("1st_Road_Class", T.StringType()),
        T.StructField("2nd_Road_Class", T.StringType()),
        T.StructField("Road_Type", T.StringType()),
        T.StructField("Junction_Control", T.StringType()),
        T.StructField("Pedestrian_Crossing-Human_Control", T.StringType()),
        T.StructField("Pedestrian_Crossing-Physical_Facilities", T.StringType()),
        T.StructField("Light_Conditions", T.StringType()),
        T.StructField("Weather_Conditions", T.StringType()),
        T.StructField("Road_Surface_Conditions", T.StringType()),
        T.StructField("Special_Conditions_at_Site", T.StringType()),
        T.StructField("Carriageway_Hazards", T.StringType()),
        T.StructField("Did_Police_Officer_Attend_Scene_of_Accident", T.StringType()),
    ]
)

MISSING_CODE = -1
DATE_FORMAT = "dd/MM/yyyy"
MISSING_TIME = "00:00"

SEVERITY = {1: "Fatal", 2: "Serious"}
SEVERITY_OTHERWISE = "Slight"
AREA = {1: "Urban", 2: "Rural"}
AREA_OTHERWISE = "Other"
WEEKDAY = {1: "Sunday", 2: "Monday", 3: "Tuesday", 4: "Wednesday", 5: "Thursday", 6: "Friday"}
WEEKDAY_OTHERWISE = "Saturday"

WEEKDAY_ORDER = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
SEVERITY_ORDER = ["Slight", "Serious", "Fatal"]
SEVERITY_NAMES = {
    "1": "Fatal",
    "2": "Serious",
    "3": "Slight",
    "1.0": "Fatal",
    "2.0": "Serious",
    "3.0": "Slight",
}
SEVERE_CODES = [1, 2]

MISSING_CODE_COLUMNS = [
    "Location_Easting_OSGR",
    "Location_Northing_OSGR",
    "Longitude",
    "Latitude",
    "Light_Conditions",
    "Weather_Conditions",
    "Road_Surface_Conditions",
    "Urban_or_Rural_Area",
    "Junction_Control",
    "Pedestrian_Crossing-Physical_Facilities",
    "Special_Conditions_at_Site",
    "Carriageway_Hazards",
]

PROFILE_COLUMNS = [
    "Police_Force",
    "Accident_Severity",
    "Number_of_Vehicles",
    "Number_of_Casualties",
    "Day_of_Week",
    "Local_Authority_(District)",
    "Local_Authority_(Highway)",
    "1st_Road_Class",
    "Road_Type",
    "Speed_limit",
    "Junction_Control",
    "2nd_Road_Class",
    "Pedestrian_Crossing-Human_Control",
    "Pedestrian_Crossing-Physical_Facilities",
    "Light_Conditions",
    "Weather_Conditions",
    "Road_Surface_Conditions",
    "Special_Conditions_at_Site",
    "Carriageway_Hazards",
    "Urban_or_Rural_Area",
    "Did_Police_Officer_Attend_Scene_of_Accident",
]

DISTRIBUTIONS = {
    "Severity_Label": "Accident Severity",
    "Day_Name": "Day of Week",
    "Road_Type": "Road Type",
    "Speed_limit": "Speed Limit",
    "Light_Conditions": "Light Conditions",
    "Weather_Conditions": "Weather Conditions",
    "Road_Surface_Conditions": "Road Surface Conditions",
}

CORRELATION_COLUMNS = [
    "Accident_Severity",
    "Day_of_Week",
    "Road_Type",
    "Light_Conditions",
    "Weather_Conditions",
    "Road_Surface_Conditions",
    "Urban_or_Rural_Area",
    "1st_Road_Class",
    "Junction_Control",
    "Pedestrian_Crossing-Physical_Facilities",
    "Special_Conditions_at_Site",
    "Carriageway_Hazards",
    "Police_Force",
    "Longitude",
    "Latitude",
    "Number_of_Vehicles",
    "Speed_limit",
    "Hour",
    "Month",
    "Year",
]

LABEL_COLUMN = "Accident_Severity"
TARGET_CLASS = 2
MODEL_CATEGORICAL = [
    "Day_of_Week",
    "Road_Type",
    "Light_Conditions",
    "Weather_Conditions",
    "Road_Surface_Conditions",
    "Urban_or_Rural_Area",
    "1st_Road_Class",
    "Junction_Control",
    "Pedestrian_Crossing-Physical_Facilities",
    "Special_Conditions_at_Site",
    "Carriageway_Hazards",
    "Police_Force",
]
MODEL_NUMERIC = ["Longitude", "Latitude", "Number_of_Vehicles", "Speed_limit", "Hour", "Month", "Year"]
SEED = 42
TRAIN_PERCENT = 70
NUM_TREES = 50
MAX_DEPTH = 10
SAMPLE_FRACTION = 0.1
SAMPLE_CAP = 50_000
TOP_VALUES = 5
HEAD_ROWS = 5
# --- End of fixed values. ---

# Ours: cell width of the density grid in degrees.
GRID_STEP = 0.05
