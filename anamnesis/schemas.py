"""Schemas of the record files."""

from pyspark.sql.types import DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType


def _schema(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


S, I, L, D = StringType(), IntegerType(), LongType(), DoubleType()

PATIENTS = _schema(Id=S, BIRTHDATE=DateType(), RACE=S, ETHNICITY=S, GENDER=S)
CONDITIONS = _schema(Id=S, PATIENT=S, CODE=S, DESCRIPTION=S, ONSET=TimestampType(), DIAGNOSED=TimestampType())
SYMPTOMS = _schema(CONDITION_ID=S, PATIENT=S, SYMPTOM_CODE=S, SYMPTOM_DISPLAY=S, VALUE_CODE=S, VALUE_DISPLAY=S)
ENCOUNTER_CONDITIONS = _schema(START=TimestampType(), STOP=TimestampType(), PATIENT=S, ENCOUNTER=S, CODE=S, DESCRIPTION=S)
ENCOUNTER_SYMPTOMS = _schema(SYMPTOM_CODE=S, SYMPTOM_DISPLAY=S, ENCOUNTER=S, PATIENT=S)
COMPACT = _schema(PATIENT=S, GENDER=S, RACE=S, ETHNICITY=S, AGE_BEGIN=I, AGE_END=I, PATHOLOGY=S, NUM_SYMPTOMS=I, SYMPTOMS=S)
SPARSE = _schema(Index=L, LABEL=I, GENDER=I, RACE=I, AGE=I, SYMPTOMS=S)
RUN_LOG = _schema(
    dataset=S, model=S, train_size=D, fold_num=I, train_sample_size=L,
    accuracy_train_score=D, accuracy_test_score=D, top_5_train_score=D, top_5_test_score=D,
)
GRID_RESULT = (
    "name string, accuracy struct<train:double,test:double>, top_2 struct<train:double,test:double>, "
    "top_5 struct<train:double,test:double>, stats struct<train_time:double,score_time:double,model_size:bigint>"
)
