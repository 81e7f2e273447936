"""The schemas, declared and never inferred."""

from __future__ import annotations

SOURCE = "struct<sourceUrl:string,college:string,campus:string,title:string>"
LECTURE = (
    "sourceUrl string, college string, campus string, title string, topic string, lectureStart string, lectureEnd string, location string, speaker string, speakerTitle string, speakerAffiliation string, inviter string, "
    "speakerBio string, organizer string, publishTime string, publishTimeSource string, timeConfidence string, timeNote string, abstract string, speakerSource string, listTitle string, ocrExtracted boolean, "
    "newsFilterBypass boolean, isMultiLecture boolean, lectureIndex int, lectureCount int, sourceCount int, host string, participants string, meetingId string, meetingPlatform string, notes array<string>, merged boolean, "
    f"sources array<{SOURCE}>"
)
LIST_URL = "struct<url:string,collect_mode:string>"
COLLEGE = f"name string, campus string, base string, list_urls array<{LIST_URL}>, exclude_urls array<string>, skip_news_filter boolean"
VISITS = "total bigint, by_day map<string,bigint>"
COUNTERS = "url string, visits bigint, likes bigint"
